"""Polygons: overlay shares and shared borders of boxes, and of rings of any form by Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, ratio


def _cells(boxes: DataFrame, size: float) -> DataFrame:
    """A row for each grid cell that a box meets."""
    span = lambda low, high: F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size))
    return boxes.withColumn("_cx", F.explode(span("x1", "x2"))).withColumn("_cy", F.explode(span("y1", "y2")))


def queen_adjacency(boxes: DataFrame, size: float) -> DataFrame:
    """``src dst`` of boxes (``area_id x1 y1 x2 y2``) that touch or meet; boxes meet over a grid of cells of ``size``."""
    a = _cells(boxes, size).select(F.col("area_id").alias("src"), *[F.col(c).alias(f"a{c}") for c in ("x1", "y1", "x2", "y2")], "_cx", "_cy")
    b = _cells(boxes, size).select(F.col("area_id").alias("dst"), "x1", "y1", "x2", "y2", "_cx", "_cy")
    met = a.join(b, ["_cx", "_cy"]).where("src <> dst and ax1 <= x2 and x1 <= ax2 and ay1 <= y2 and y1 <= ay2")
    return met.select("src", "dst").distinct()


def overlay_share(boxes: DataFrame, covers: DataFrame, size: float) -> DataFrame:
    """``area_id share``: part of each box under the union of ``covers`` (``x1 y1 x2 y2``).

    Covers of one box are cut at each other's edges into strips, whose covered lengths are added up, so overlaps count once.
    """
    from pyspark.sql.window import Window

    a = _cells(boxes, size).select("area_id", *[F.col(c).alias(f"a{c}") for c in ("x1", "y1", "x2", "y2")], "_cx", "_cy")
    b = _cells(covers, size)
    cut = a.join(b, ["_cx", "_cy"]).select("area_id", F.greatest("ax1", "x1").alias("x1"), F.greatest("ay1", "y1").alias("y1"), F.least("ax2", "x2").alias("x2"), F.least("ay2", "y2").alias("y2")).where("x1 < x2 and y1 < y2").distinct()
    edges = cut.select("area_id", F.explode(F.array("x1", "x2")).alias("x")).distinct()
    strips = edges.withColumn("_to", F.lead("x").over(Window.partitionBy("area_id").orderBy("x"))).where("_to is not null").withColumnRenamed("area_id", "_id")
    runs = cut.join(strips, (F.col("area_id") == F.col("_id")) & (F.col("x1") <= F.col("x")) & (F.col("x2") >= F.col("_to")))
    before = F.max("y2").over(Window.partitionBy("area_id", "x").orderBy("y1", "y2").rowsBetween(Window.unboundedPreceding, -1))
    high = runs.withColumn("_new", F.greatest(F.lit(0.0), F.col("y2") - F.greatest("y1", F.coalesce(before, F.col("y1")))))
    covered = high.groupBy("area_id").agg(F.sum(F.col("_new") * (F.col("_to") - F.col("x"))).alias("_covered"))
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return boxes.join(covered, "area_id", "left").select("area_id", clip(ratio(F.col("_covered"), area), 0.0, 1.0).alias("share"))


def ring_areas(shapes: DataFrame) -> DataFrame:
    """``area_id area x1 y1 x2 y2`` of polygons as arrays of rings of ``(x, y)`` (the first outer, the others holes), by the shoelace sum.

    Rows of one ``area_id`` are parts of one shape: their areas add up.
    """
    ring = lambda r: F.abs(F.aggregate(F.zip_with(r, F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1)), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda a, x: a + x)) / 2
    parts = F.transform("rings", lambda r, i: F.when(i == 0, ring(r)).otherwise(-ring(r)))
    every = lambda c: F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p[c])))
    xs, ys = every("x"), every("y")
    sized = shapes.select("area_id", F.aggregate(parts, F.lit(0.0), lambda a, x: a + x).alias("area"), F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))
    return sized.groupBy("area_id").agg(F.sum("area").alias("area"), *[F.min(c).alias(c) for c in ("x1", "y1")], *[F.max(c).alias(c) for c in ("x2", "y2")])


def shared_borders(shapes: DataFrame) -> DataFrame:
    """``src dst`` of polygons that share a vertex: queen adjacency where borders meet in vertices; an equi-join on points."""
    points = shapes.select("area_id", F.explode(F.flatten("rings")).alias("p")).select("area_id", "p.x", "p.y").distinct()
    other = points.select(F.col("area_id").alias("dst"), "x", "y")
    return points.withColumnRenamed("area_id", "src").join(other, ["x", "y"]).where("src <> dst").select("src", "dst").distinct()
