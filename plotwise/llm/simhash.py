"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import guarded, joined_to_one, picked, restored, sent_if_few, written
from .graph import components

BATCH = 1 << 16


def fingerprint_of(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text; see :func:`fingerprints`."""
    words = (text or "").encode().lower().split()  # bytes: A-Z alone are lowered, ASCII white space alone cuts
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(b" ".join(words), seed)
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    begins, ends = [0, *ends[:-width].tolist()], (ends[width - 1 :] - 1).tolist()
    n, set_in = len(ends), np.zeros(64, np.int64)
    for lo in range(0, n, BATCH):
        h = np.array([digest(line[a:b], seed) for a, b in zip(begins[lo : lo + BATCH], ends[lo : lo + BATCH], strict=True)], "<u8")
        set_in += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id fingerprint`` (a long) of every row of ``docs``.

    Words are runs of anything but ASCII white space, A-Z lowered; shingles of ``width`` words joined by a space, repeats
    included (fewer words: the whole sequence), are hashed by XXH64 with seed 42; a bit is 1 if it is set in over half of
    the hashes. Null texts and texts without a word have fingerprint zero.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint_of(t, width) for t in batch.column(1).to_pylist()], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fingerprint"])

    rows = picked(docs, "doc_id", "text")
    return rows.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, fingerprint long")


def ball_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links ``a b`` that connect all fingerprints of ``fps`` (distinct, column ``fp``) within ``radius`` bits of each other.

    Each fingerprint emits all variants within half the radius. Two at ``radius`` bits or fewer share a variant, and all
    that share one are within the radius, so a chain through a variant's fingerprints keeps every connection without its
    pairs; each link is verified. A variant has at most as many fingerprints as its own ball has points.
    """
    if radius < 0 or radius % 2 or radius > 4:
        raise ValueError("radius must be 0, 2 or 4")
    masks = [sum(1 << b for b in bits) for r in range(radius // 2 + 1) for bits in combinations(range(64), r)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    variants = fps.select("fp", F.explode(F.array(*[F.lit(m) for m in signed])).alias("_mask")).select("fp", F.col("fp").bitwiseXOR(F.col("_mask")).alias("variant"))
    met = variants.withColumn("a", F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))).where(F.col("a").isNotNull())
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= radius).select("a", F.col("fp").alias("b")).distinct()


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """``doc_id fingerprint component_id`` for every row of ``docs``.

    Fingerprints (:func:`fingerprints`) link at ``radius`` or fewer differing bits; ``component_id`` is the smallest
    ``doc_id`` that can be reached, itself included. Equal fingerprints are one node, so a group of copies of any size
    is a single node with a minimum. Repeated rows repeat; a null id is no candidate for the smallest (a component with
    no other id has a null ``component_id``). An empty table gives no row.
    """
    held = written(fingerprints(docs, width), "simhash")
    counted = held.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least"), F.count("*").alias("_n"))
    nodes = written(counted, "simhash-nodes")
    roots = written(components(ball_links(nodes.select("fp"), radius)), "simhash-roots")
    grouped = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = written(grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("_n")), "simhash-least")
    named = written(joined_to_one(grouped, least, "root").select("fp", "component_id", "_n"), "simhash-names")
    out = joined_to_one(held.withColumnRenamed("fingerprint", "fp"), named, "fp")
    return out.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = 2, width: int = 3, most_broadcast: int = 1_000_000) -> DataFrame:
    """The rows of ``docs``, one for each component of :func:`near_duplicates`: that with the smallest ``doc_id``.

    Of rows that repeat an id the one with the least hash of its columns stays (of equal hashes, any: 64 bits). Rows
    with a null id can't be named and stay. Up to ``most_broadcast`` ids are broadcast to the rows; for more, rows move.
    """
    held, names = guarded(docs, {"doc_id", "text"})
    first = written(near_duplicates(held, radius, width).where("doc_id = component_id").groupBy(F.col("doc_id").alias("_kept")).agg(F.count("*").alias("_n")), "simhash-first")
    kept = held.join(sent_if_few(first, first.count(), most_broadcast), F.col("doc_id") == F.col("_kept"), "left_semi")
    again = first.where("_n > 1").select("_kept")
    n_again = again.count()
    if n_again:
        again = sent_if_few(again, n_again, most_broadcast)
        columns = held.columns
        several = kept.join(again, F.col("doc_id") == F.col("_kept"), "left_semi")
        one = several.groupBy("doc_id").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("_row")).select("_row.*")
        kept = kept.join(again, F.col("doc_id") == F.col("_kept"), "left_anti").union(one)
    return restored(kept.union(held.where(F.col("doc_id").isNull())), names)
