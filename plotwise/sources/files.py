"""Reading and writing the engine's tables."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import AREA_ID_ALIASES, canonical_id, normalize_id, resolve_column
from ..functions.numeric import to_number


def text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all columns as strings: ids never turn into numbers."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def features_csv(spark: SparkSession, path: str, numbers: Sequence[str]) -> DataFrame:
    """Feature table with normalised ids; ``numbers`` as doubles, null where they are none; missing ones are null."""
    df = text_csv(spark, path)
    column = resolve_column(df, AREA_ID_ALIASES, required=True)
    held = df.withColumn("area_id", normalize_id(F.col(column))).where(F.length("area_id") > 0)
    return held.withColumns({c: to_number(F.col(c)) if c in df.columns else F.lit(None).cast("double") for c in numbers})


def excluded_ids(spark: SparkSession, path: str, canonical: bool = True) -> DataFrame:
    """``area_id`` of an exclusion list whose id column has any of several names, else the first column."""
    df = text_csv(spark, path)
    low = {c.lower(): c for c in df.columns}
    column = resolve_column(df, AREA_ID_ALIASES) or next((low[c] for c in low if "geoid" in c and "bg" in c), None) or next((low[c] for c in low if "geoid" in c), df.columns[0])
    out = canonical_id(F.col(f"`{column}`")) if canonical else F.trim(F.col(f"`{column}`"))
    return df.select(out.alias("area_id")).where(F.length("area_id") > 0).distinct()


def geojson(spark: SparkSession, path: str, id_column: str) -> DataFrame:
    """``area_id rings properties``, a row for each polygon in a GeoJSON file of features; a MultiPolygon has several.

    Other geometries and features without one give no row; a ring is an array of points ``(x, y)``.
    """
    polygon = "array<array<array<double>>>"
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("features"))
    at, kind = F.col("geometry.coordinates"), F.col("geometry.type")
    one, many = F.array(F.from_json(at, polygon)), F.from_json(at, f"array<{polygon}>")
    parts = rows.select("properties", F.explode(F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)).alias("_rings"))
    ring = lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return parts.select(F.col("properties").getItem(id_column).alias("area_id"), F.transform("_rings", ring).alias("rings"), "properties")


def geocode_cache(spark: SparkSession, path: str) -> DataFrame:
    """``key label`` of a JSON object from ``lat,lon`` with six decimals to a label."""
    return spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "label"))


def with_labels(points: DataFrame, cache: DataFrame) -> DataFrame:
    """Labels of points that the cache knows; nothing is asked for over the network, and unknown points stay null."""
    key = F.format_string("%.6f,%.6f", F.col("lat"), F.col("lon"))
    return points.withColumn("_key", key).join(cache, F.col("_key") == F.col("key"), "left").drop("_key", "key")


def first_existing(folder: str, names: Sequence[str]) -> str | None:
    return next((p for n in names if os.path.exists(p := os.path.join(folder, n))), None)


def unzipped(path: str, folder: str) -> list[str]:
    """The files of a zip archive, extracted once; names that would leave the folder are refused."""
    root, out = os.path.realpath(folder), []
    with zipfile.ZipFile(path) as z:
        for info in z.infolist():
            to = os.path.realpath(os.path.join(root, info.filename))
            if os.path.commonpath([root, to]) != root:
                raise ValueError(f"unsafe name in archive: {info.filename}")
            if not info.is_dir():
                if not os.path.exists(to):
                    z.extract(info, root)
                out.append(to)
    return out


def newest(paths: Sequence[str]) -> str | None:
    return max(paths, key=os.path.getmtime, default=None)


def write_by_scenario(kept: DataFrame, path: str) -> None:
    """Kept sites in a folder for each t."""
    kept.withColumn("t_label", F.format_string("%.3f", "t")).write.mode("overwrite").partitionBy("t_label").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_manifest(spark: SparkSession, path: str, **facts) -> None:
    """One JSON row of facts about a run, with its time."""
    import json

    row = spark.range(1).select(F.lit(json.dumps(facts, default=str, sort_keys=True)).alias("facts"), F.current_timestamp().alias("made_at"))
    row.write.mode("overwrite").json(path)
