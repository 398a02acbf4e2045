"""The strict-to-relaxed ladder of scenarios: schedules, candidates, spaced selection and its summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import haversine
from ..functions.tables import settled

# Start and end of each schedule.
SCHEDULES = {"fdr_alpha": (0.01, 0.10), "min_pass_rate": (0.70, 0.40), "store_buffer_mi": (2.0, 0.8), "ring_fallback_mi": (1.0, 0.5)}
SELECT_COUNT = (20.0, 10.0)
DEMAND = (4000.0, 10000.0, 3.0, 1.0)  # floor, top, k, p
SEARCH = (1.5, 1.0)  # base, step of the square root
LEAST_FALLBACK, MOST_SITES, SHORTLIST = 0.01, 15, 10
BOROUGHS = ("Bronx", "Brooklyn", "Manhattan", "Queens", "Staten Island", "Unknown")


def ladder(spark: SparkSession, steps: int = 100) -> DataFrame:
    """One row for each scenario t in [0, 1): its thresholds."""
    t = F.col("t")
    low, top, k, p = DEMAND
    line = lambda a, b: F.lit(a) + F.lit(b - a) * t
    out = spark.range(steps).select(F.col("id").cast("int").alias("scenario_idx"), (F.col("id") / F.lit(float(steps))).alias("t"))
    out = out.withColumns({name: line(*ends) for name, ends in SCHEDULES.items()})
    return out.withColumns({
        "ring_fallback_mi": F.greatest("ring_fallback_mi", F.lit(LEAST_FALLBACK)),
        "min_select": F.bround(line(*SELECT_COUNT)).cast("int"),
        "demand": F.bround(F.lit(low) + F.lit(top - low) / F.pow(F.lit(1.0) + F.lit(k) * t, F.lit(p))),
        "max_search_mi": F.lit(SEARCH[0]) + F.lit(SEARCH[1]) * F.sqrt(t),
    })


def with_defaults(areas: DataFrame) -> DataFrame:
    """Missing counts become 0; a missing p becomes 1, or 0 if no area has one (the test is then passed by all)."""
    known = areas.agg(F.count("p_fdr").alias("_known"))
    p = F.when(F.col("_known") == 0, F.lit(0.0)).otherwise(F.coalesce("p_fdr", F.lit(1.0)))
    filled = areas.join(F.broadcast(known)).withColumn("p_fdr", p).drop("_known")
    return filled.withColumns({"pass_rate": F.coalesce("pass_rate", F.lit(0.0)), "select_count": F.coalesce("select_count", F.lit(0))})


def eligible(areas: DataFrame, steps: DataFrame, anchor_ids: DataFrame) -> DataFrame:
    """Areas that are no anchors and pass, but for the ring, the loosest test of all scenarios, with defaults."""
    loosest = steps.agg(F.max("fdr_alpha").alias("_p"), F.min("min_pass_rate").alias("_pass"), F.min("min_select").alias("_select"))
    held = with_defaults(areas).join(F.broadcast(anchor_ids.select("area_id").distinct()), "area_id", "left_anti").join(F.broadcast(loosest))
    return held.where("p_fdr <= _p and pass_rate >= _pass and select_count >= _select").drop("_p", "_pass", "_select")


def passing(rings: DataFrame, steps: DataFrame) -> DataFrame:
    """Of areas with their ``scenario_idx ring_mi`` those that pass all tests of the scenario, with ``ring_used_mi``."""
    met = rings.join(F.broadcast(steps), "scenario_idx")
    passed = met.where("p_fdr <= fdr_alpha and pass_rate >= min_pass_rate and select_count >= min_select and ring_mi <= max_search_mi")
    return passed.withColumn("ring_used_mi", F.when(F.col("ring_mi") > 0, F.col("ring_mi")).otherwise(F.col("ring_fallback_mi")))


def candidates(areas: DataFrame, rings: DataFrame, steps: DataFrame, anchor_ids: DataFrame) -> DataFrame:
    """Areas that pass all tests of a scenario, with ``ring_mi`` and ``ring_used_mi``; anchors are none."""
    held = eligible(areas, steps, anchor_ids)
    return passing(held.join(rings.withColumnRenamed("src", "area_id"), "area_id"), steps)


def with_anchor_miles(points: DataFrame, anchors: DataFrame) -> DataFrame:
    """``points`` with ``anchor_mi``, the miles to the nearest of a few ``anchor_lat anchor_lon`` (infinite without any)."""
    listed = anchors.agg(F.collect_list(F.struct("anchor_lat", "anchor_lon")).alias("_anchors"))
    miles = F.array_min(F.transform("_anchors", lambda a: haversine(F.col("lat"), F.col("lon"), a["anchor_lat"], a["anchor_lon"])))
    return points.join(F.broadcast(listed)).withColumn("anchor_mi", F.coalesce(miles, F.lit(float("inf")))).drop("_anchors")


def off_anchors(found: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Candidates no nearer to any anchor than their ring or the store buffer. ``anchors``: a few ``anchor_lat anchor_lon``, or None if ``found`` has ``anchor_mi``."""
    away = found if anchors is None else with_anchor_miles(found, anchors)
    return away.where("anchor_mi >= greatest(ring_used_mi, store_buffer_mi)").drop("anchor_mi")


ORDER = ("_pass", "_select", "row_ord", "area_id")


def _ordered(found: DataFrame) -> DataFrame:
    return found.withColumns({"_pass": -F.col("pass_rate"), "_select": -F.col("select_count")})


def spaced(found: DataFrame, most: int = MOST_SITES, most_folded: int = 1000) -> DataFrame:
    """The greedy choice in each scenario: ``scenario_idx area_id kept_rank``.

    Candidates come by falling pass rate and select count, then row order; one stays if it is at least the larger of
    both rings away from all that stayed before, up to ``most``. See :func:`_chosen`.
    """
    rows = _chosen(found, most, most_folded)
    return rows.select("scenario_idx", F.col("_row.area_id").alias("area_id"), "kept_rank")


def _near(a: Column, b: Column) -> Column:
    return haversine(a["lat"], a["lon"], b["lat"], b["lon"]) < F.greatest(a["ring_used_mi"], b["ring_used_mi"])


def _chosen(found: DataFrame, most: int, most_folded: int) -> DataFrame:
    """``scenario_idx _row kept_rank``; ``_row``: all columns of a candidate that stays.

    The first ``most_folded`` candidates of each scenario (each task sends no more) are folded in one list. The choice
    is over where ``most`` stayed or no candidate comes after; elsewhere the next candidates after the list, of those not
    near to any that stayed, are folded on it, until all scenarios are over. So every candidate has its turn, no task
    holds a scenario, and ``found``, which is computed once a round, is nowhere stored. Up to 1000 Spark cuts each task's
    rows before they move.
    """
    found = _ordered(found)
    row = F.struct(*ORDER, *[c for c in found.columns if c not in (*ORDER, "scenario_idx")])
    kind = found.select(F.array(row).alias("x")).schema["x"].dataType
    first = Window.partitionBy("scenario_idx").orderBy(*ORDER)

    def step(kept: Column, x: Column) -> Column:
        full = (F.size(kept) >= most) | F.exists(kept, lambda k: _near(k, x))
        return F.when(full, kept).otherwise(F.concat(kept, F.array(x)))

    over, held = None, None  # held: of scenarios that are not over, what stayed and the last candidate that had its turn
    while True:
        rest = found
        if held is not None:
            here = F.struct(*ORDER)
            rest = found.join(F.broadcast(held), "scenario_idx").where((here > F.col("_last")) & ~F.exists("_kept", lambda k: _near(k, F.struct("lat", "lon", "ring_used_mi"))))
            rest = rest.drop("_kept", "_last")
        top = rest.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= most_folded).drop("_place")
        lists = top.groupBy("scenario_idx").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
        begin = F.array().cast(kind)
        if held is not None:  # a scenario without further candidates is over, too
            lists = held.drop("_last").join(lists, "scenario_idx", "left")
            begin = F.col("_kept")
        folded = F.aggregate(F.coalesce("_rows", F.array().cast(kind)), begin, step)
        more = F.coalesce(F.size("_rows"), F.lit(0)) >= most_folded
        lists = lists.select("scenario_idx", folded.alias("_kept"), F.when(more, F.struct(*[F.element_at("_rows", -1)[c].alias(c) for c in ORDER])).alias("_last"))
        lists = settled(lists)
        done = (F.size("_kept") >= most) | F.col("_last").isNull()
        over = lists.where(done) if over is None else over.union(lists.where(done))
        held = lists.where(~done)
        if held.isEmpty():
            return over.select("scenario_idx", F.posexplode("_kept").alias("_n", "_row")).select("scenario_idx", "_row", (F.col("_n") + 1).cast("int").alias("kept_rank"))


def kept_sites(found: DataFrame, most: int = MOST_SITES, most_folded: int = 1000) -> DataFrame:
    """The chosen candidates with all their columns, and ``kept_rank``."""
    rows = _chosen(found, most, most_folded)
    return rows.select("scenario_idx", *[F.col("_row")[c].alias(c) for c in found.columns if c != "scenario_idx"], "kept_rank")


def summary(kept: DataFrame, steps: DataFrame) -> DataFrame:
    """One row for each scenario: thresholds, counts and medians (0 where nothing was kept), and kept sites by borough."""
    counts = [F.count_if(F.col("borough") == b).alias(f"borough_{b.replace(' ', '_').lower()}") for b in BOROUGHS]
    found = kept.groupBy("scenario_idx").agg(F.count("*").alias("kept_count"), F.sum("potential_bus").alias("total_potentialbus"), F.avg("pass_rate").alias("avg_passrate"), F.percentile("ring_used_mi", F.lit(0.5)).alias("med_ring"), *counts)
    return steps.join(found, "scenario_idx", "left").fillna(0, found.columns[1:])


def by_area(kept: DataFrame, steps: int = 100) -> DataFrame:
    """One row for each area that any scenario kept: how often, from which t, with which ring; one aggregation.

    The borough is the most frequent, the first by name on a tie.
    """
    median = lambda c: F.percentile(c, F.lit(0.5))
    out = kept.groupBy("area_id").agg(
        F.count("*").alias("ladder_count"), F.min("t").alias("t_first"), F.max("t").alias("t_last"), median("ring_used_mi").alias("ring_med"), median("lat").alias("lat"), median("lon").alias("lon"),
        F.mode("borough", True).alias("borough"), median("pass_rate").alias("pass_rate_med"), F.sum("potential_bus").alias("pbus_sum"), F.max("pass_rate").alias("pass_rate"),
    )
    out = out.withColumn("ladder_freq", F.col("ladder_count") / F.lit(float(steps)))
    return out.withColumn("robustness", F.col("ladder_freq") * (1.0 - F.coalesce("t_first", F.lit(1.0))))


def shortlist(areas: DataFrame, n: int = SHORTLIST) -> DataFrame:
    order = [F.desc("robustness"), F.desc("ladder_count"), F.desc("pass_rate"), F.col("area_id")]
    top = areas.orderBy(*order).limit(n)
    return top.withColumn("shortlist_rank", F.row_number().over(Window.orderBy(*order)))  # n rows
