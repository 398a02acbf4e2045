"""Exact top-k inner products in tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import picked, written

BLOCK = "block long, n int, dim int, largest double, uids binary, ids binary, vectors binary"
BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("dim", pa.int32()), ("largest", pa.float64()), ("uids", pa.binary()), ("ids", pa.binary()), ("vectors", pa.binary())])


def packed(uids: np.ndarray, ids: np.ndarray, vectors: np.ndarray, block: int) -> pa.RecordBatch:
    """A block row, sorted by id; components as the smallest integer type that holds them."""
    order = np.lexsort((uids, ids))
    largest = float(np.abs(vectors).max(initial=0))
    kind = next(k for k, most in (("i1", 2**7), ("i2", 2**15), ("i4", 2**31), ("i8", 2**63)) if largest < most)
    row = {"block": block, "n": len(ids), "dim": vectors.shape[1], "largest": largest, "uids": uids[order].astype("<i8").tobytes(), "ids": ids[order].astype("<i8").tobytes(), "vectors": vectors[order].astype("<" + kind).tobytes()}
    return pa.RecordBatch.from_pylist([row], schema=BLOCK_SCHEMA)


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, dim = row["n"], row["dim"]
    size = len(row["vectors"]) // (n * dim) if n * dim else 1
    return np.frombuffer(row["uids"], "<i8"), np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"], f"<i{size}").reshape(n, dim)


def tile_scores(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Exact integer inner products; ``most`` bounds their absolute values. Vectors of unequal length: the rest counts as zero."""
    dim = min(a.shape[1], b.shape[1])
    if most >= 2**62:
        raise OverflowError("inner products beyond 62 bits")
    kind = np.float64 if most < 2**53 else np.int64
    return (a[:, :dim].astype(kind) @ b[:, :dim].astype(kind).T).astype(np.int64, copy=False)


def tile_top(scores: np.ndarray, own: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the columns of its ``k`` best scores, ties to the left; ``own``: column left out, or -1."""
    rows, n = scores.shape
    scores[np.flatnonzero(own >= 0), own[own >= 0]] = np.iinfo(np.int64).min
    out = []
    for r in range(rows):
        s, left = scores[r], n - (own[r] >= 0)
        if left > k:
            least = np.partition(s, n - k)[n - k]
            above = np.flatnonzero(s > least)
            take = np.concatenate([above, np.flatnonzero(s == least)[: k - len(above)]])
        else:
            take = np.flatnonzero(s != np.iinfo(np.int64).min)
        out.append(take[np.lexsort((take, -s[take]))])
    return out


def exact_top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, block_rows: int = 4096, fan_in: int = 16) -> DataFrame:
    """The ``k`` rows with the highest integer inner product to each query row: ``query_id rank vec_id score``.

    A component x counts as ``floor(scale * x)``. Queries: rows whose ``vec_id`` is divisible by ``every``; candidates:
    every row but the query's own; ties go to the smaller ``vec_id``. Rows with a null id, a null vector, or a null or
    non-finite component take no part. Repeated rows are rows of their own: each is a candidate, and each query row
    gets its own ``k``. Vectors of unequal length compare over the shorter one.

    Rows are packed into blocks of at most ``block_rows``, the queries once more into full blocks of their own. Each
    block of queries meets each block of candidates (a product of blocks, not of rows) in one matrix product, which
    keeps ``k`` columns a query; the lists of a query are merged as a tree, ``fan_in`` at a time on average.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = picked(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seen, made, held = TaskContext.get().partitionId() << 32, 0, 0, {}
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            offsets, flat = lists.offsets.to_numpy(), np.floor(lists.values.to_numpy(zero_copy_only=False) * scale)
            if len(flat) and np.abs(flat).max() >= 2**62:
                raise OverflowError("components beyond 62 bits")
            lengths = np.diff(offsets)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                matrix = flat[offsets[at][:, None] + np.arange(dim)].astype(np.int64)
                held.setdefault(int(dim), []).append((first + seen + at, ids[at], matrix))
                while sum(len(x[1]) for x in held[int(dim)]) >= block_rows:
                    whole = [np.concatenate(x) for x in zip(*held[int(dim)], strict=True)]
                    yield packed(*[x[:block_rows] for x in whole], first + made)
                    made, held[int(dim)] = made + 1, [tuple(x[block_rows:] for x in whole)]
            seen += len(ids)
        for parts in held.values():
            whole = [np.concatenate(x) for x in zip(*parts, strict=True)]
            if len(whole[1]):
                yield packed(*whole, first + made)
                made += 1

    blocks = written(rows.mapInArrow(cut, BLOCK), "topk-blocks")

    def queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                uids, ids, matrix = unpacked(row)
                if (mine := ids % every == 0).any():
                    yield packed(uids[mine], ids[mine], matrix[mine].astype(np.int64), row["block"])

    def refilled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                parts = held.setdefault(row["dim"], [])
                parts.append([x.astype(np.int64) for x in unpacked(row)])
                if sum(len(p[1]) for p in parts) >= block_rows:
                    yield packed(*[np.concatenate(x) for x in zip(*parts, strict=True)], row["block"])
                    parts.clear()
        for parts in held.values():
            if parts:
                yield packed(*[np.concatenate(x) for x in zip(*parts, strict=True)], 0)

    own_parts = written(blocks.mapInArrow(queries, BLOCK), "topk-query-parts")
    n_asked = own_parts.agg(F.sum("n")).first()[0] or 0
    asked = written(own_parts.repartition(-(-n_asked // block_rows) or 1).mapInArrow(refilled, BLOCK), "topk-queries")

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_uids, q_ids, q = unpacked({c[2:]: row[c] for c in row if c[:2] == "q_"})
                uids, ids, c = unpacked(row)
                most = row["q_largest"] * row["largest"] * min(row["q_dim"], row["dim"])
                by_uid = np.argsort(uids)
                at = by_uid[np.minimum(np.searchsorted(uids, q_uids, sorter=by_uid), len(uids) - 1)]
                columns_of_own = np.where(uids[at] == q_uids, at, -1)
                for lo in range(0, len(q_ids), 512):
                    scores = tile_scores(q[lo : lo + 512], c, most)
                    top = tile_top(scores, columns_of_own[lo : lo + 512], k)
                    sizes = [len(t) for t in top]
                    columns = np.concatenate(top) if top else np.zeros(0, int)
                    lines = np.repeat(np.arange(len(top)), sizes)
                    entries = pa.StructArray.from_arrays([pa.array(-scores[lines, columns]), pa.array(ids[columns]), pa.array(uids[columns])], ["worse", "vec_id", "uid"])
                    best = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), entries)
                    yield pa.RecordBatch.from_arrays([pa.array(q_uids[lo : lo + 512]), pa.array(q_ids[lo : lo + 512]), pa.array(np.full(len(top), row["block"])), best], ["query_uid", "query_id", "block", "best"])

    pairs = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns]).crossJoin(blocks)
    lists = pairs.mapInArrow(tiles, "query_uid long, query_id long, block long, best array<struct<worse:long,vec_id:long,uid:long>>")
    count = blocks.count()
    merged = F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best")
    groups = fan_in ** max(0, int(np.ceil(np.log(max(count, 2)) / np.log(fan_in))) - 1)
    while groups > 1:
        lists = lists.groupBy("query_uid", "query_id", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("block")).agg(merged)
        groups //= fan_in
    best = lists.groupBy("query_uid", "query_id").agg(merged)
    return best.select("query_id", F.posexplode("best").alias("rank", "_best")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("_best.vec_id").alias("vec_id"), (-F.col("_best.worse")).alias("score"))
