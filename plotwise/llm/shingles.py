"""Near duplicates at a given Jaccard similarity of word shingles: MinHash bands find pairs, the shingles decide."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, guarded, restored, sent_if_few, written

# At similarity 0.8 all bands of a pair differ with probability (1 - 0.8 ** ROWS) ** BANDS, 5e-8.
BANDS, ROWS, SEED = 32, 4, 42
BLOCK = 1 << 8
#: The sketch of a text: the two lowest bits of each minimum. Of two texts at similarity 0.8 it differs in 25.6 bits on
#: average with a standard deviation of 5.8; a pair beyond FARTHEST (5.9 deviations) is at 0.8 with a probability of 1e-7.
SKETCH = [f"s{k}" for k in range(4)]
FARTHEST, LEAST = 60, 0.8
#: For texts that are still to compare after the first round, a sharper one: the lowest bit of each of SHARP_BITS more
#: minima. At 0.8 it differs in 102.4 bits on average with a standard deviation of 9.6, and beyond FARTHEST_SHARP with a
#: probability of 4e-8; pairs below a similarity of 0.69 are beyond it more often than not.
SHARP_BITS, FARTHEST_SHARP = 1024, 157
SHARP = [f"s{k}" for k in range(SHARP_BITS // 64)]


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """Distinct hashes of a text's shingles; words and short texts as in :func:`plotwise.llm.simhash.fingerprints`."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    begins, ends = [0, *ends[:-width]] if len(words) > width else [0], [e - 1 for e in ends[width - 1 :]] or [len(line)]
    return np.unique(np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(begins, ends, strict=True)], np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def sketch_of(least: np.ndarray) -> np.ndarray:
    """The sketch of a signature, as four 64-bit numbers."""
    return np.packbits(np.concatenate([least & np.uint64(1), least >> np.uint64(1) & np.uint64(1)]).astype(np.uint8)).view("<i8")


def hash_family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of ``n`` hash functions of 64 bits."""
    mul, add = np.random.default_rng(seed).integers(0, 1 << 63, (2, 1, n), np.uint64)
    return 2 * mul + np.uint64(1), add


def minima(h: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The least value of ``h`` under each hash function."""
    return np.min([(h[lo : lo + BLOCK, None] * mul + add).min(axis=0) for lo in range(0, len(h), BLOCK)], axis=0)


def bands(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id bands size`` and the sketch: a hash for each band of the MinHash signature, and the number of shingles.

    Texts without a word and null ids are left out.
    """
    mul, add = hash_family(BANDS * ROWS, SEED)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, sizes, sketches = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = shingle_hashes(text, width)
                if len(h):
                    least = minima(h, mul, add)
                    ids.append(i)
                    sizes.append(len(h))
                    sketches.append(sketch_of(mixed(least)))
                    out.append([xxhash.xxh64_intdigest(part.tobytes(), k) for k, part in enumerate(least.reshape(BANDS, ROWS))])
            values = pa.array(np.array(out, np.uint64).view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * BANDS, pa.int32()), values)
            parts = np.array(sketches, np.int64).reshape(-1, len(SKETCH)).T
            arrays = [pa.array(ids, pa.int64()), lists, pa.array(sizes, pa.int64()), *[pa.array(np.ascontiguousarray(x)) for x in parts]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "bands", "size", *SKETCH])

    fields = ", ".join(f"{c} long" for c in ("size", *SKETCH))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.col("doc_id").isNotNull()).mapInArrow(work, f"doc_id long, bands array<long>, {fields}")


def mixed(least: np.ndarray) -> np.ndarray:
    """Minima mixed once more, as the bits of a minimum are not even: equal ones stay equal, others agree by chance."""
    x = (least ^ least >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def may_be_near(least: float, sketch: list[str] = SKETCH) -> Column:
    """Whether a row and the other, whose columns begin with ``r_``, can reach ``least`` by sizes and, from LEAST on, sketch."""
    sizes = F.least("size", "r_size") >= F.greatest("size", "r_size") * F.lit(least)
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"r_{c}"))) for c in sketch), F.lit(0))
    return sizes & (apart <= (FARTHEST if sketch == SKETCH else FARTHEST_SHARP)) if least >= LEAST else sizes


def texts_of(ids: DataFrame, docs: DataFrame, most_broadcast: int = 1_000_000) -> DataFrame:
    """``doc_id text`` of the rows of ``docs`` with an id in ``ids`` (column ``doc_id``): only these texts move."""
    wanted = written(ids.select(F.col("doc_id").alias("_wanted")).distinct(), "near-ids")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(sent_if_few(wanted, wanted.count(), most_broadcast), F.col("doc_id") == F.col("_wanted"), "left_semi")


def sharpened(open_: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``open_`` with the sharper sketch, in the columns SHARP, in place of the first one."""
    mul, add = hash_family(SHARP_BITS, SEED + 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.packbits((mixed(minima(shingle_hashes(t, width), mul, add)) & np.uint64(1)).astype(np.uint8)).view("<i8") for t in batch.column(1).to_pylist()]
            parts = np.array(found, np.int64).reshape(-1, len(SHARP)).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(x)) for x in parts]], ["doc_id", *SHARP])

    signs = texts_of(open_, docs).mapInArrow(work, ", ".join(f"{c} long" for c in ("doc_id", *SHARP)))
    return open_.drop(*SKETCH).join(signs, "doc_id")


def verified(pairs: DataFrame, docs: DataFrame, width: int, least: float) -> DataFrame:
    """The ``doc_id`` of the rows of ``pairs`` (``rep doc_id``, a written table) whose texts have ``least`` of their shingles in common."""
    texts = written(texts_of(pairs.select("doc_id").union(pairs.select("rep")), docs), "near-texts")
    of = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"_{c}"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = lru_cache(64)(shingle_hashes)
        for batch in batches:
            near = [jaccard(hashes(a, width), hashes(b, width)) >= least for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    both = pairs.join(of("doc_id"), "doc_id").join(of("rep"), "rep").select("rep", "doc_id", "_rep", "_doc_id")
    out = written(both.mapInArrow(work, "rep long, doc_id long").select("doc_id").distinct(), "near")
    dropped(texts)
    return out


def without_near(docs: DataFrame, least: float = 0.8, width: int = 5, reps: int = 1, most_broadcast: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` without those near to an earlier one: of two that stay, no pair found reaches ``least``.

    ``docs``: rows with distinct ``doc_id`` (rows with a null id stay), read several times. Similarity is the Jaccard
    similarity of the sets of ``width``-word shingles. Texts that share a band meet; in a round the ``reps`` smallest ids
    of a band's texts are held against the others, first by size and sketch (:func:`may_be_near`), then by all shingles,
    and each text found near to one goes; the rest meet again, with four times as many, until all that stay were compared.
    So a group of copies of any size takes pairs in proportion to it. A band of n texts that are not near takes about n * n
    / 2 comparisons of sketches, which are sharper after the first round (:func:`sharpened`), but those that differ are no
    pairs and no text moves for them. A text goes only for a smaller id, so a chain of near pairs leads from it to a text
    that stays. Up to ``most_broadcast`` ids that go are broadcast, so that no text moves; for more, texts move once.
    """
    held, names = guarded(docs, {"doc_id", "text"})
    each = Window.partitionBy("band")
    ranked = lambda m: m.select("*", F.count("*").over(each).alias("_n"), F.row_number().over(each.orderBy("doc_id")).alias("_rank")).where("_n > 1").drop("_n")
    signs = written(bands(held, width), "signatures")
    # ids and bands alone are sorted at first; sketches come to those that meet another
    met = ranked(signs.select("doc_id", F.explode("bands").alias("band")))
    open_ = written(met.join(signs.drop("bands"), "doc_id"), "bands")
    dropped(signs)
    gone, sketch = [], SKETCH
    while not open_.isEmpty():
        if gone and sketch is SKETCH and least >= LEAST:
            before, open_, sketch = open_, written(sharpened(open_, held, width), "bands"), SHARP
            dropped(before)
        first = open_.where(F.col("_rank") <= reps).select("band", F.col("doc_id").alias("rep"), *[F.col(c).alias(f"r_{c}") for c in ("size", *sketch)])
        pairs = written(open_.join(first, "band").where(F.col("rep") < F.col("doc_id")).where(may_be_near(least, sketch)).select("rep", "doc_id").distinct(), "near-pairs")
        gone.append(verified(pairs, held, width, least))
        left = open_.where(F.col("_rank") > reps).drop("_rank").join(gone[-1], "doc_id", "left_anti")
        before, open_, reps = open_, written(ranked(left), "bands"), 4 * reps
        dropped(before, pairs)
    if gone:
        every = reduce(DataFrame.union, gone).select(F.col("doc_id").alias("_gone"))
        held = held.join(sent_if_few(every, every.count(), most_broadcast), F.col("doc_id") == F.col("_gone"), "left_anti")
    return restored(held, names)
