"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import guarded, picked, restored, unit_hash, words_of, written

BLOCK, PARTS = 4096, 4096
PLAN = ["size", "source_size", "target", "rate", "copies", "taken"]


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """Target of each source: ``(source, source_size, target, weight)`` from ``(source, source_size)``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share[0]/share[1]`` of all sizes. A
    target stops at ``most`` times its source's size and the excess goes to the others by weight, until none is above.
    The input has a row a source. Sorting by ``most * size / weight`` makes the resharing one pass: the sources that
    stop are a prefix of that order. All sums are integers, so a target is one division, alike on every run.
    No source: no row; sources of size zero: target zero.
    """
    up, down = share
    n = len(weights)
    every = Window.partitionBy(F.lit(0))
    place = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sizes.withColumn("weight", F.get(F.array(*[F.lit(int(w)) for w in weights]), F.pmod(place, F.lit(n)).cast("int")).cast("long"))
    by_fill = every.orderBy((F.col("source_size") * most / F.col("weight")), F.col("source").asc_nulls_last())
    before, rest = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    levels = (
        ranked.withColumn("_left", F.lit(up) * F.sum("source_size").over(every) - F.lit(down * most) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("_weights", F.sum("weight").over(rest))
        .withColumn("_stops", F.col("_left") * F.col("weight") > F.lit(down * most) * F.col("source_size") * F.col("_weights"))
        # of the sources that do not stop, the first holds the water line
        .withColumn("_line", F.first(F.when(~F.col("_stops"), F.struct("_left", "_weights")), ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    shared = (F.col("_line._left") * F.col("weight")).cast("double") / (F.lit(down) * F.col("_line._weights")).cast("double")
    cap = (F.lit(most) * F.col("source_size")).cast("double")
    return levels.select("source", "source_size", "weight", F.when(F.col("_stops") | F.col("_line").isNull(), cap).otherwise(F.least(shared, cap)).alias("target"))


def placed(rows: DataFrame, most_broadcast: int) -> DataFrame:
    """``rows`` with ``_place``, a string that tells apart rows of one ``doc_id`` or of none: equal rows are numbered.

    Rows whose id comes once stay where they are. The others are counted as groups of equal rows, before the shuffle, and
    made again from their number in blocks, so a group of any size is no task's list and its rows need no order.
    """
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1 and doc_id is not null")
    again = written(ids.select(F.col("doc_id").alias("_again")), "mix-repeated")
    few = F.broadcast(again) if again.count() <= most_broadcast else again
    repeated = F.col("doc_id") == F.col("_again")
    single = rows.where(F.col("doc_id").isNotNull()).join(few, repeated, "left_anti").withColumn("_place", F.lit("1"))
    several = rows.join(few, repeated, "left_semi").union(rows.where(F.col("doc_id").isNull()))
    groups = several.groupBy(*rows.columns).agg(F.count("*").alias("_m"))
    key, others = ["doc_id", "_md5", "source"], [c for c in rows.columns if c not in ("doc_id", "source", "text", "size", "_md5")]
    groups = numbered(groups, key, others) if others else groups.withColumn("_first", F.lit(0).cast("long"))
    blocks = groups.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_m") - 1) / BLOCK))))
    dealt = blocks.repartition("doc_id", "_md5", "_first", "_block")
    number = F.explode(F.sequence(F.col("_block") * BLOCK + 1, F.least("_m", (F.col("_block") + 1) * BLOCK)))
    return single.union(dealt.withColumn("_number", number).select(*rows.columns, (F.col("_first") + F.col("_number")).cast("string").alias("_place")))


def numbered(groups: DataFrame, key: list[str], others: list[str]) -> DataFrame:
    """``groups`` of ``_m`` equal rows with ``_first``, the rows of the same ``key`` that are counted before them.

    The groups of a key are dealt by the hash of the other columns into PARTS parts, each counted in a task of its own.
    """
    hashed = groups.withColumn("_h", F.xxhash64(F.to_json(F.struct(*others)))).withColumn("_part", F.pmod("_h", F.lit(PARTS)))
    rest = lambda *by: F.coalesce(F.sum("_m").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = hashed.groupBy(*key, "_part").agg(F.sum("_m").alias("_m")).withColumn("_before", rest(*key, "_part"))
    sums = sums.select(*[F.col(c).alias(f"_of_{c}") for c in (*key, "_part")], "_before")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*key, "_part")]
    joined = hashed.withColumn("_within", rest(*key, "_part", "_h")).join(sums, same)
    return joined.select(*groups.columns, (F.col("_before") + F.col("_within")).alias("_first"))


def mixing_plan(docs: DataFrame, narrow: bool = False, **options) -> DataFrame:
    """``docs`` with ``size source_size target rate copies taken``: what the mix takes of each document.

    ``rate = target / source_size``; a document is taken ``floor(rate)`` times and once more where a number drawn from
    ``seed``, ``doc_id``, the MD5 of the text, ``source`` and its place among rows that share these (:func:`placed`) is
    below the fraction: reruns agree, and rows without an id or with one id draw apart. ``size``: an expression, by
    default the number of words, 0 for null text. Null sources are one source, the last. A source of size zero has rate
    0. Columns of ``docs`` with the names above are replaced; others stay (``narrow``: only ``doc_id source``, and texts
    are read once). Sizes are summed per source before the shuffle; the per-source table is broadcast up to
    ``most_broadcast`` sources and joined by shuffle beyond. An empty table gives no row.
    """
    if narrow:
        docs = picked(docs, "doc_id", "source", "text")
    held, names = guarded(docs, {"doc_id", "source", "text"})
    return restored(_planned(held, narrow, **options), [n for n in names if not narrow or n[0] != "text"], PLAN)


def _planned(docs: DataFrame, narrow: bool = False, size: Column | None = None, seed: int = 42, most_broadcast: int = 50_000, weights: Sequence[int] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    size = (F.size(words_of(F.col("text"))) if size is None else size).cast("long")
    sized = docs.withColumns({"size": size, "_md5": F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))})
    if narrow:
        sized = written(sized.drop("text"), "mix-sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per_source = written(source_targets(sums, weights, share, most), "mix-sources").select(F.col("source").alias("_source"), "source_size", "target")
    if per_source.count() <= most_broadcast:
        per_source = F.broadcast(per_source)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    draw = unit_hash(seed, F.col("doc_id"), F.col("_md5"), F.col("source"), F.col("_place"))
    return (
        placed(sized, most_broadcast)
        .join(per_source, F.col("source").eqNullSafe(F.col("_source")), "left")
        .withColumn("rate", rate)
        .withColumn("copies", F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("_source", "_md5", "_place")
    )


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as :func:`mixing_plan` takes it, in the columns of ``docs``."""
    held, names = guarded(docs, {"doc_id", "source", "text"})
    planned = _planned(held, **options).where(F.col("copies") > 0)
    return restored(planned.withColumn("_copy", F.explode_outer(F.sequence(F.lit(1), F.col("copies").cast("int")))), names)
