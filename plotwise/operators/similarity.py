"""Composite similarity of candidate and anchor profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values.
WEIGHTS = {"comp": 0.35, "disp": 0.20, "scale": 0.15, "shape": 0.15, "anchor": 0.15}
BOROUGH_PENALTY, LEAST_P90 = 0.02, 1e-9


def breakdown(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs of a few profiles with distances, their share of the 90th percentile, and similarities in percent.

    The result has a row a pair by definition; ``b`` (the anchors) is a handful of rows and is broadcast.
    """
    names = ("anchor", "borough", "mu_vec", "cov_flat", "cluster_size", "max_radius_mi", "mean_radius_mi", "adj_density", "anch_gap")
    side = lambda df, s: df.select(*[F.col(c).alias(f"{s}_{c}") for c in names])
    pairs = side(a, "a").crossJoin(F.broadcast(side(b, "b")))
    norm = lambda x, y: F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    scale = lambda s: F.array(*[F.log1p(F.col(f"{s}_{c}").cast("double")) for c in ("cluster_size", "max_radius_mi", "mean_radius_mi")])
    found = pairs.select(
        F.col("a_anchor"), F.col("b_anchor"), F.col("a_borough"), F.col("b_borough"),
        norm(F.col("a_mu_vec"), F.col("b_mu_vec")).alias("dist_comp"), norm(F.col("a_cov_flat"), F.col("b_cov_flat")).alias("dist_disp"), norm(scale("a"), scale("b")).alias("dist_scale"),
        F.abs(F.col("a_adj_density") - F.col("b_adj_density")).alias("dist_shape"), F.abs(F.col("a_anch_gap") - F.col("b_anch_gap")).alias("dist_anchor"),
    )
    p90 = found.agg(*[F.greatest(F.percentile(f"dist_{k}", F.lit(0.9)), F.lit(LEAST_P90)).alias(f"_{k}") for k in WEIGHTS])
    found = found.join(F.broadcast(p90)).withColumns({f"norm_{k}": F.col(f"dist_{k}") / F.col(f"_{k}") for k in WEIGHTS}).drop(*[f"_{k}" for k in WEIGHTS])
    total = F.when(~F.col("a_borough").eqNullSafe(F.col("b_borough")), F.lit(BOROUGH_PENALTY)).otherwise(F.lit(0.0))
    for k, w in WEIGHTS.items():
        total = total + w * F.col(f"norm_{k}")
    found = found.withColumn("composite_dist", total)
    last = found.agg(F.greatest(F.percentile("composite_dist", F.lit(0.9)), F.lit(LEAST_P90)).alias("_d"))
    percent = lambda x: F.least(F.greatest(100.0 * (1.0 - x), F.lit(0.0)), F.lit(100.0))
    return found.join(F.broadcast(last)).withColumn("similarity_pct", percent(F.col("composite_dist") / F.col("_d"))).withColumns({f"sim_{k}_pct": percent(F.col(f"norm_{k}")) for k in WEIGHTS}).drop("_d")


def top_match(pairs: DataFrame) -> DataFrame:
    """Each candidate's best anchor, the first by name on a tie."""
    order = Window.partitionBy("a_anchor").orderBy(F.desc("similarity_pct"), "b_anchor")
    return pairs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
