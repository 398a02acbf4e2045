"""Distance joins: nearest points, ranges, demand rings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import haversine
from ..functions.tables import written

# One degree of latitude is more than this many miles.
DEGREE_MILES = 69.0
# Latitude and longitude of each anchor.
ANCHORS = (
    (40.7000, -73.9900), (40.7075, -73.9550), (40.7150, -73.9750), (40.7220, -73.9300), (40.7300, -73.9950),
    (40.7370, -73.9600), (40.7450, -73.9100), (40.7520, -73.9850), (40.7600, -73.9450), (40.7680, -73.9050),
    (40.7760, -73.9800), (40.7840, -73.9400), (40.7920, -73.9000), (40.8000, -73.9650), (40.8080, -73.9250),
)


def literal_anchors(spark) -> DataFrame:
    rows = [(i, a, b) for i, (a, b) in enumerate(ANCHORS)]
    return spark.createDataFrame(rows, "anchor_idx int, anchor_lat double, anchor_lon double")


def snap_anchors(areas: DataFrame, anchors: DataFrame) -> DataFrame:
    """``anchor_idx area_id``: for each anchor the area with the least squared distance in degrees, first row on a tie.

    Each area meets the few anchors; minima are aggregated before the shuffle. Areas without coordinates take no part.
    """
    points = areas.where("lat is not null and lon is not null").select("area_id", "row_ord", "lat", "lon")
    d2 = (F.col("lat") - F.col("anchor_lat")) ** 2 + (F.col("lon") - F.col("anchor_lon")) ** 2
    met = points.join(F.broadcast(anchors)).withColumn("_at", F.struct(d2.alias("d"), "row_ord", "area_id"))
    return met.groupBy("anchor_idx").agg(F.min("_at").alias("_at")).select("anchor_idx", F.col("_at.area_id").alias("area_id"))


def sides(miles: float, most_lat: float = 60.0) -> tuple[float, float]:
    """Height and width in degrees of a grid cell that is at least ``miles`` high and wide."""
    return miles / DEGREE_MILES, miles / (DEGREE_MILES * math.cos(math.radians(most_lat)))


def in_cell(points: DataFrame, miles: float, lat: str = "lat", lon: str = "lon", most_lat: float = 60.0) -> DataFrame:
    """``points`` that have coordinates, with their cell ``_y _x``."""
    tall, wide = sides(miles, most_lat)
    return points.where(f"{lat} is not null and {lon} is not null").withColumns({"_y": F.floor(F.col(lat) / tall), "_x": F.floor(F.col(lon) / wide)})


def in_cells_around(points: DataFrame, miles: float, lat: str = "lat", lon: str = "lon", most_lat: float = 60.0) -> DataFrame:
    """``points`` that have coordinates, once for each of the 3 x 3 cells ``_y _x`` around them."""
    tall, wide = sides(miles, most_lat)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    each = points.where(f"{lat} is not null and {lon} is not null").withColumn("_c", F.explode(around))
    return each.withColumns({"_y": F.floor(F.col(lat) / tall) + F.col("_c.i"), "_x": F.floor(F.col(lon) / wide) + F.col("_c.j")}).drop("_c")


def _met(left: DataFrame, right: DataFrame, miles: float, most_lat: float = 60.0) -> DataFrame:
    """All pairs within ``miles`` with both cells' columns: ``_y _x src dst weight dist_mi``; dealt by ``_y _x``."""
    tall, _ = sides(miles, most_lat)
    a = in_cell(left.select(F.col("area_id").alias("src"), F.col("lat").alias("_lat1"), F.col("lon").alias("_lon1")), miles, "_lat1", "_lon1", most_lat)
    extra = [c for c in right.columns if c not in ("area_id", "lat", "lon")]
    b = in_cells_around(right.select(F.col("area_id").alias("dst"), F.col("lat").alias("_lat2"), F.col("lon").alias("_lon2"), *extra), miles, "_lat2", "_lon2", most_lat)
    # the latitudes alone rule out most of the pairs in a cell, before any trigonometry
    near = a.join(b, ["_y", "_x"]).where((F.col("src") != F.col("dst")) & (F.abs(F.col("_lat1") - F.col("_lat2")) <= tall))
    return near.withColumn("dist_mi", haversine(F.col("_lat1"), F.col("_lon1"), F.col("_lat2"), F.col("_lon2"))).where(F.col("dist_mi") <= miles)


def range_join(left: DataFrame, right: DataFrame, miles: float, most_lat: float = 60.0) -> DataFrame:
    """``src dst dist_mi`` of all pairs within ``miles``; pairs of one id are left out.

    ``left``, ``right``: ``area_id lat lon``, with latitudes up to ``most_lat`` degrees north or south. Points meet over
    a grid whose cells are at least ``miles`` wide, so an equi-join on 3 x 3 cells finds every pair; the distance decides.
    """
    points = lambda df: df.select("area_id", "lat", "lon")
    return _met(points(left), points(right), miles, most_lat).select("src", "dst", "dist_mi")


def around(few: DataFrame, points: DataFrame, miles: float, lat: str, lon: str) -> DataFrame:
    """The rows of ``few`` (a broadcast handful, with ``lat lon`` columns of these names) each with all ``points`` within ``miles``.

    The few stand in nine cells each, so the points are neither copied nor shuffled.
    """
    near = in_cell(points, miles).join(F.broadcast(in_cells_around(few, miles, lat, lon)), ["_y", "_x"]).drop("_y", "_x")
    return near.where(haversine(F.col(lat), F.col(lon), F.col("lat"), F.col("lon")) <= miles)


def ring_steps(left: DataFrame, points: DataFrame, miles: float, enough: float, pairs_each: int = 150, halvings: int = 10) -> DataFrame:
    """``src dist_mi before cum_weight``: neighbours of each ``left`` by distance, up to the one that reaches ``enough`` or to ``miles``.

    ``left``: ``area_id lat lon``, distinct ids; ``points``: these and ``weight``, at least 0. ``cum_weight`` is the weight
    of the neighbours up to each, as in :func:`cumulative_weights`, ``before`` that without it. What lies beyond the
    neighbour that reaches ``enough`` is in no ring, so the search begins with the largest halving of ``miles`` at which
    points have ``pairs_each`` pairs in cells on average, and areas that found less look twice as far, up to ``miles``.
    The pairs of an area stay in the task of its cell; only steps are kept.
    """
    points = points.select("area_id", "lat", "lon", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    left = left.select("area_id", "lat", "lon").where("lat is not null and lon is not null")
    level = F.explode(F.array(*[F.lit(miles / 2**k) for k in range(halvings + 1)]))
    tall, wide = sides(1.0)
    cells = points.where("lat is not null and lon is not null").select(level.alias("r"), "lat", "lon").groupBy("r", F.floor(F.col("lat") / (tall * F.col("r"))).alias("y"), F.floor(F.col("lon") / (wide * F.col("r"))).alias("x")).count()
    sizes = cells.groupBy("r").agg((9 * F.sum(F.col("count") * F.col("count")) / F.sum("count")).alias("each")).collect()
    reach = max([r["r"] for r in sizes if r["each"] <= pairs_each], default=miles / 2**halvings)
    out = None
    while True:
        near = _met(left, points, reach)
        whole = Window.partitionBy("_y", "_x", "src").orderBy("dist_mi", "dst")  # no rows move: pairs are dealt by _y, _x
        cum = F.sum("weight").over(whole.rowsBetween(Window.unboundedPreceding, 0))
        total = F.sum("weight").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        steps = near.withColumns({"cum_weight": cum, "_total": total}).withColumn("before", F.lag("cum_weight", 1, 0.0).over(whole))
        steps = steps.where(F.col("before") < enough)
        if reach < miles:
            steps = steps.where(F.col("_total") >= enough)
        found = written(steps.select("src", "dist_mi", "before", "cum_weight"), "ring-steps")
        out = found if out is None else out.unionByName(found)
        if reach >= miles:
            return out
        left = left.join(found.select(F.col("src").alias("area_id")).distinct(), "area_id", "left_anti")
        left, reach = written(left, "ring-left"), min(miles, 2 * reach)
        if left.isEmpty():
            return out


def cumulative_weights(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """``edges`` with ``cum_weight``: weight of the neighbours up to each, by distance. ``weights``: ``area_id weight``."""
    held = edges.join(weights.select(F.col("area_id").alias("dst"), F.coalesce("weight", F.lit(0.0)).alias("weight")), "dst")
    order = Window.partitionBy("src").orderBy("dist_mi", "dst").rowsBetween(Window.unboundedPreceding, 0)
    return held.withColumn("cum_weight", F.sum("weight").over(order))


def demand_rings(cumulative: DataFrame, ladder: DataFrame) -> DataFrame:
    """``src scenario_idx ring_mi``: the least distance at which the weight reaches the demand, within the search radius.

    ``cumulative``: ``src dist_mi cum_weight`` of all neighbours, or the steps of :func:`ring_steps`. Weights grow with
    distance, so of an area's neighbours the one that brings the weight from below a demand up to it is the ring's;
    each neighbour meets the few scenarios. Pairs that reach no demand have no row. Other columns of steps stay.
    """
    if "before" not in cumulative.columns:
        order = Window.partitionBy("src").orderBy("dist_mi", "cum_weight")
        cumulative = cumulative.select("src", "dist_mi", "cum_weight", F.lag("cum_weight").over(order).alias("before"))
    steps = F.broadcast(ladder.select("scenario_idx", "demand", "max_search_mi"))
    reached = (F.col("cum_weight") >= F.col("demand")) & (F.coalesce("before", F.lit(float("-inf"))) < F.col("demand")) & (F.col("dist_mi") <= F.col("max_search_mi"))
    found = cumulative.join(steps, reached)
    others = [c for c in cumulative.columns if c not in ("src", "dist_mi", "before", "cum_weight")]
    return found.select("src", "scenario_idx", F.col("dist_mi").alias("ring_mi"), *others)


def nearest_anchor_miles(points: DataFrame, anchors: DataFrame) -> DataFrame:
    """``area_id anchor_mi``: miles from each point to the nearest of a few anchors."""
    d = haversine(F.col("lat"), F.col("lon"), F.col("anchor_lat"), F.col("anchor_lon"))
    return points.join(F.broadcast(anchors)).groupBy("area_id").agg(F.min(d).alias("anchor_mi"))


def total_bounds(points: DataFrame, pad: float = 0.0) -> DataFrame:
    return points.agg((F.min("lat") - pad).alias("south"), (F.min("lon") - pad).alias("west"), (F.max("lat") + pad).alias("north"), (F.max("lon") + pad).alias("east"), ((F.min("lat") + F.max("lat")) / 2).alias("centre_lat"), ((F.min("lon") + F.max("lon")) / 2).alias("centre_lon"))
