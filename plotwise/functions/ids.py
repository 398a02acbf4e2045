"""Area ids, flags and column aliases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
PREFIX = "1500000US"
ID_LENGTH = 12
BOROUGHS = {"005": "Bronx", "047": "Brooklyn", "061": "Manhattan", "081": "Queens", "085": "Staten Island"}
AREA_ID_ALIASES = ("GEOID_BG", "GEOID", "GEOIDFQ")
BLOCK_ID_ALIASES = ("GEOID20", "GEOID", "GEOID10", "BLOCK_ID", "geoid20", "geoid")
LAND_ALIASES = ("ALAND20", "ALAND", "aland20", "aland")
WATER_ALIASES = ("AWATER20", "AWATER", "awater20", "awater")
BOROUGH_ALIASES = ("borough", "BoroName", "BORONAME", "boro", "boro_name", "BORO_NM")


def resolve_column(df: DataFrame, aliases: Sequence[str], required: bool = False) -> str | None:
    """The first of ``aliases`` that ``df`` has, in exactly that case."""
    found = next((a for a in aliases if a in df.columns), None)
    if found is None and required:
        raise ValueError(f"none of the columns {', '.join(aliases)}")
    return found


def bare(raw: Column) -> Column:
    s = F.trim(F.coalesce(raw.cast("string"), F.lit("")))
    return F.when(s.startswith(PREFIX), F.substring(s, len(PREFIX) + 1, 1000)).otherwise(s)


def normalize_id(raw: Column) -> Column:
    """Id with prefix, trailing ``.0``, scientific notation and lost leading zeros mended; null gives ``''``."""
    s = F.regexp_replace(bare(raw), r"\.0$", "")
    s = F.when(s.rlike("[eE]"), F.coalesce(s.try_cast("decimal(38,0)").cast("string"), s)).otherwise(s)
    return F.when(s.rlike(r"^[0-9]{1,11}$"), F.lpad(s, ID_LENGTH, "0")).otherwise(s)


def canonical_id(raw: Column) -> Column:
    """The last 12 digits of an id, zero-padded; no digit gives ``''``."""
    digits = F.regexp_replace(bare(raw), r"\D", "")
    return F.when(digits == "", F.lit("")).otherwise(F.lpad(F.right(digits, F.lit(ID_LENGTH)), ID_LENGTH, "0"))


def plain_id(raw: Column) -> Column:
    """Id without its prefix, otherwise as it is."""
    return F.replace(F.coalesce(raw.cast("string"), F.lit("")), F.lit(PREFIX), F.lit(""))


def block_area(raw: Column) -> Column:
    """Area of a block id: its first 12 characters."""
    return F.substring(raw, 1, ID_LENGTH)


def borough_of(area_id: Column) -> Column:
    code = F.substring(area_id, 3, 3)
    out = F.lit("Unknown")
    for fips, name in BOROUGHS.items():
        out = F.when(code == fips, F.lit(name)).otherwise(out)
    return out


def exclusion_flag(raw: Column) -> Column:
    """Flag in lower case without blanks; null is ``nan``, which excludes."""
    return F.lower(F.trim(F.coalesce(raw, F.lit("nan"))))


def with_area_id(df: DataFrame, normalize=normalize_id, name: str = "area_id") -> DataFrame:
    """Resolves and normalises the id column; rows without an id go."""
    column = resolve_column(df, AREA_ID_ALIASES, required=True)
    return df.withColumn(name, normalize(F.col(column))).where(F.length(name) > 0)
