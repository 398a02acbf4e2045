"""Running selection counts over run batches as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.montecarlo import counts


def run_batches(spark: SparkSession, path: str) -> DataFrame:
    """Stream of the run rows in a folder that batches are appended to."""
    return spark.readStream.schema("run int, area_id string, cluster_rank int, selected boolean").parquet(path)


def running_counts(stream: DataFrame) -> DataFrame:
    """Counts by area so far; one row of state an area (update or complete mode)."""
    return counts(stream)
