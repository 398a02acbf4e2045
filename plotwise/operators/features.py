"""Feature tables: cleaning, shares, robust scaling, scores, ranks and the exclusion ledger."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ids import exclusion_flag
from ..functions.numeric import clip, nullify, ratio, safe_log1p, share, to_number

# Fixed values.
FEATURES = ("share_college_plus", "share_commute_60p", "pop_density", "occ_units_density", "potbus_per_1k", "median_income")
LOGGED = ("pop_density", "occ_units_density", "potbus_per_1k", "median_income")
SCORE_WEIGHTS = {"share_college_plus": 0.1181, "share_commute_60p": -0.1725, "pop_density": 0.1198, "occ_units_density": 0.1305, "potbus_per_1k": 0.3039, "median_income": 0.1552}
OPEN_SPACE_LIMIT, LAND_LIMIT = 0.60, 0.10
REASONS = ("excluded_by_flag", "excluded_open_space", "excluded_water_dominated", "excluded_missing_features", "excluded_missing_geometry")


def numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: to_number(F.col(c)) for c in columns})


def percentiles(df: DataFrame, columns: Sequence[str], ps: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles ``<column>_p<i>`` of finite values, over all rows or by group; one row (a group)."""
    return df.groupBy(*by).agg(*[F.percentile(nullify(F.col(c)), F.lit(p)).alias(f"{c}_p{i}") for c in columns for i, p in enumerate(ps)])


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """``df`` with the columns of a table of one row."""
    return df.join(F.broadcast(one_row.limit(1)))


def impute(df: DataFrame, columns: Sequence[str], empty: float | None = 0.0) -> DataFrame:
    """Nulls, NaN and infinities become the column's median (``empty`` for a column without a number)."""
    held = with_scalars(df, percentiles(df, columns, [0.5]))
    fill = lambda c: F.coalesce(nullify(F.col(c)), F.col(f"{c}_p0"), F.lit(empty).cast("double"))
    return held.withColumns({c: fill(c) for c in columns}).drop(*[f"{c}_p0" for c in columns])


def log_features(df: DataFrame, columns: Sequence[str] = LOGGED) -> DataFrame:
    return df.withColumns({c: safe_log1p(F.col(c)) for c in columns})


def winsorize(df: DataFrame, columns: Sequence[str], p: float = 0.01, only_spread: bool = False) -> DataFrame:
    """Columns clipped to their percentiles p and 1 - p; ``only_spread``: only where these differ."""
    held = with_scalars(df, percentiles(df, columns, [p, 1 - p]))

    def cut(c: str) -> Column:
        cut = clip(F.col(c), F.col(f"{c}_p0"), F.col(f"{c}_p1"))
        return F.when(F.col(f"{c}_p0") < F.col(f"{c}_p1"), cut).otherwise(F.col(c)) if only_spread else cut

    return held.withColumns({c: cut(c) for c in columns}).drop(*[f"{c}_p{i}" for c in columns for i in (0, 1)])


def robust_scale(df: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """``<column><suffix>``: (x - median) / IQR after median imputation; an IQR of 0 counts as 1."""
    filled = impute(df.withColumns({f"{c}{suffix}": F.col(c).cast("double") for c in columns}), [f"{c}{suffix}" for c in columns])
    names = [f"{c}{suffix}" for c in columns]
    held = with_scalars(filled, percentiles(filled, names, [0.25, 0.5, 0.75]))
    spread = lambda c: F.col(f"{c}_p2") - F.col(f"{c}_p0")
    scaled = {c: (F.col(c) - F.col(f"{c}_p1")) / F.when(spread(c) == 0, F.lit(1.0)).otherwise(spread(c)) for c in names}
    return held.withColumns(scaled).drop(*[f"{c}_p{i}" for c in names for i in (0, 1, 2)])


def ensure_z(df: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Adds the z columns that are missing; a missing source column counts as 0."""
    df = df.withColumns({c: F.lit(0.0) for c in columns if c not in df.columns})
    missing = [c for c in columns if f"{c}_z" not in df.columns]
    return robust_scale(df, missing) if missing else df


def cluster_matrix(df: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Impute, log, winsorise all, scale."""
    out = winsorize(log_features(impute(df, columns), [c for c in LOGGED if c in columns]), columns)
    return robust_scale(out, columns)


def selection_matrix(df: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Log, winsorise the logged columns that spread, impute, scale."""
    logged = [c for c in LOGGED if c in columns]
    out = df.withColumns({c: nullify(F.col(c)) for c in columns})
    return robust_scale(impute(winsorize(log_features(out, logged), logged, only_spread=True), columns), columns)


def location_score(df: DataFrame, weights: Mapping[str, float] = SCORE_WEIGHTS, name: str = "location_score") -> DataFrame:
    """Weighted sum of the z columns that exist; nulls and infinities count as 0."""
    terms = [F.lit(w) * F.coalesce(nullify(F.col(f"{c}_z")), F.lit(0.0)) for c, w in weights.items() if f"{c}_z" in df.columns]
    total = F.lit(0.0)
    for t in terms:
        total = total + t
    return df.withColumn(name, total)


def rank_groups(df: DataFrame, group: str, score: str = "location_score") -> DataFrame:
    """``group mean_score group_rank`` by falling mean, ties by group."""
    means = df.groupBy(group).agg(F.avg(score).alias("mean_score"))
    return means.withColumn("group_rank", F.row_number().over(Window.orderBy(F.desc("mean_score"), F.col(group))))  # a row a group


def with_group_rank(df: DataFrame, group: str, score: str = "location_score") -> DataFrame:
    return df.join(rank_groups(df, group, score).select(group, "group_rank"), group, "left")


def cluster_profiles(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    parts = [f(F.col(c)).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("median", lambda x: F.percentile(x, F.lit(0.5))), ("count", F.count))]
    return df.groupBy(group).agg(*parts)


def pass_rate(selected: Column, eligible: Column) -> Column:
    return ratio(selected.cast("double"), eligible.cast("double"))


def with_shares(df: DataFrame, land: str = "aland", water: str = "awater") -> DataFrame:
    a, w = to_number(F.col(land)), to_number(F.col(water))
    return df.withColumns({"land_share": share(a, w), "water_share": share(w, a)})


def shares_by_area(blocks: DataFrame, area: str, land: str, water: str) -> DataFrame:
    """Land and water of each area summed over its blocks, and their shares."""
    sums = blocks.groupBy(area).agg(F.sum(land).alias("land_area"), F.sum(water).alias("water_area"))
    return sums.withColumns({"land_share": share(F.col("land_area"), F.col("water_area")), "water_share": share(F.col("water_area"), F.col("land_area"))})


def fill_shares(areas: DataFrame, blocks: DataFrame, area: str) -> DataFrame:
    """Shares from blocks where there are any, else the area's own (columns ``aland awater``)."""
    own = with_shares(areas).withColumnsRenamed({"land_share": "_land", "water_share": "_water"})
    joined = own.join(blocks.select(area, "land_share", "water_share"), area, "left")
    return joined.withColumns({"land_share": F.coalesce("land_share", "_land"), "water_share": F.coalesce("water_share", "_water")}).drop("_land", "_water")


def reason_flags(df: DataFrame) -> DataFrame:
    """The five 0/1 reasons, from ``exclusion open_space_share land_share has_features has_geometry``."""
    flags = {
        "excluded_by_flag": exclusion_flag(F.col("exclusion")) != "no",
        "excluded_open_space": F.coalesce("open_space_share", F.lit(0.0)) >= OPEN_SPACE_LIMIT,
        "excluded_water_dominated": F.coalesce("land_share", F.lit(1.0)) < LAND_LIMIT,
        "excluded_missing_features": ~F.col("has_features"),
        "excluded_missing_geometry": ~F.col("has_geometry"),
    }
    return df.withColumns({k: v.cast("int") for k, v in flags.items()})


def exclusion_ledger(geometry: DataFrame, features: DataFrame, area: str) -> DataFrame:
    """Every area of either table that is excluded, with its reasons.

    ``geometry``: area and ``open_space_share land_share``; ``features``: area and ``exclusion``. Areas of one table
    alone are in the ledger too (a union by name; a missing value of a column is null).
    """
    both = geometry.withColumn("has_geometry", F.lit(True)).join(features.withColumn("has_features", F.lit(True)), area, "left").withColumn("has_features", F.coalesce("has_features", F.lit(False)))
    alone = features.join(geometry.select(area), area, "left_anti").withColumns({"has_features": F.lit(True), "has_geometry": F.lit(False)})
    every = reason_flags(both.withColumn("exclusion", F.when(F.col("has_features"), F.col("exclusion")).otherwise(F.lit("no"))).unionByName(alone, allowMissingColumns=True))
    return every.where(" + ".join(REASONS) + " > 0").select(area, "exclusion", "open_space_share", "land_share", *REASONS)


def twin_features(df: DataFrame) -> DataFrame:
    """Shares and log densities from raw census counts.

    Reads ``edu_total edu_22 edu_23 edu_24 edu_25 commute_total commute_60p aland population occupied competitors
    potential_bus``; a zero or null whole gives 0.
    """
    n = {c: F.coalesce(to_number(F.col(c)), F.lit(0.0)) for c in ("edu_total", "edu_22", "edu_23", "edu_24", "edu_25", "commute_total", "commute_60p", "aland", "population", "occupied", "competitors", "potential_bus")}
    km2 = n["aland"] / 1e6
    return df.withColumns({
        "share_college_plus": ratio(n["edu_22"] + n["edu_23"] + n["edu_24"] + n["edu_25"], n["edu_total"]),
        "share_commute_60p": ratio(n["commute_60p"], n["commute_total"]),
        "pop_density": F.log1p(ratio(n["population"], km2)),
        "occ_units_density": F.log1p(ratio(n["occupied"], km2)),
        "comp_per_km2": F.log1p(ratio(n["competitors"], km2)),
        "potbus_per_1k": F.log1p(ratio(1000.0 * n["potential_bus"], n["population"])),
    })


def first_of_each(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def land_shading(df: DataFrame, land: str = "aland", least: float = 0.20) -> DataFrame:
    """Rows with land and a land share of at least ``least``; all rows if that leaves none."""
    passed = (F.coalesce(F.col(land), F.lit(0.0)) > 0) & (F.coalesce("land_share", F.lit(0.0)) >= least)
    held = with_scalars(df, df.agg(F.count_if(passed).alias("_passed")))
    return held.where(passed | (F.col("_passed") == 0)).drop("_passed")
