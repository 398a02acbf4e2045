"""Packing token sequences with controlled mixture, by deficit round-robin over source queues."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import once, picked, written
from .tokens import Ids, word_bpe_file

BLOCK = "block long, n long, doc_ids array<long>, sources array<string>, lengths array<int>, per_source array<struct<source:string,tokens:long>>, ids binary"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenized_blocks(docs: DataFrame, tokenizer_path: str, end_id: int, block_tokens: int) -> DataFrame:
    """Rows of ``BLOCK``: documents of all sources dealt evenly, about ``block_tokens`` ids each (a longer document alone).

    ids: each document's ids and ``end_id``, as unsigned 32-bit little-endian numbers (Parquet compresses them).
    """
    file = word_bpe_file(tokenizer_path)
    model, name = docs.sparkSession.sparkContext.broadcast(file), zlib.crc32(file.encode())

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = once(("ids", name), lambda: Ids(model.value)), np.array([end_id], "<u4").tobytes()
        first, made, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def block() -> pa.RecordBatch:
            sums: dict = {}
            for _, source, ids in held:
                sums[source] = sums.get(source, 0) + len(ids) // 4
            row = {"block": first + made, "n": size, "doc_ids": [d for d, _, _ in held], "sources": [s for _, s, _ in held], "lengths": [len(x) // 4 for _, _, x in held], "per_source": [{"source": s, "tokens": t} for s, t in sums.items()], "ids": b"".join(x for _, _, x in held)}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("block", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sources", pa.list_(pa.string())), ("lengths", pa.list_(pa.int32())), ("per_source", pa.list_(pa.struct([("source", pa.string()), ("tokens", pa.int64())]))), ("ids", pa.binary())]))

        for batch in batches:
            for doc_id, source, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), known.of(batch.column(2)), strict=True):
                held.append((doc_id, source, ids + end))
                size += len(held[-1][2]) // 4
                if size >= block_tokens:
                    yield block()
                    made, held, size = made + 1, [], 0
        if held:
            yield block()

    rows = picked(docs, "doc_id", "source", "text")
    dealt = rows.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).hint("rebalance")
    return dealt.mapInArrow(tokenize, BLOCK)


def block_starts(blocks: DataFrame) -> DataFrame:
    """``block base deficits``: ids before each block, and what each of its sources is owed there (``share * base - taken``).

    Sums run inside each writing task first and then over tasks, so that no window holds all blocks.
    """
    parts = blocks.select("block", F.shiftright("block", 32).alias("part"), "n", "per_source")

    def before(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
        own = Window.partitionBy(*by, "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        tasks = rows.groupBy(*by, "part").agg(F.sum(value).alias("_n"))
        order = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        tasks = tasks.select(*[F.col(b).alias(f"_{b}") for b in by], F.col("part").alias("_part"), F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_tasks"))
        on = F.col("part") == F.col("_part")
        for b in by:
            on = on & F.col(b).eqNullSafe(F.col(f"_{b}"))
        return rows.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0))).join(tasks, on).withColumn("before", F.col("_own") + F.col("_tasks")).drop("_own", "_tasks", "_part", *[f"_{b}" for b in by])

    bases = before(parts.drop("per_source"), "n", []).select("block", F.col("before").alias("base"))
    pairs = parts.select("block", "part", F.inline("per_source"))
    shares = pairs.groupBy(F.col("source").alias("_source")).agg(F.sum("tokens").alias("_all"))
    total = pairs.agg(F.sum("tokens").alias("_total"))
    owed = (
        before(pairs, "tokens", ["source"])
        .join(shares, F.col("source").eqNullSafe(F.col("_source")))
        .join(F.broadcast(total))  # one row
        .join(bases, "block")
        .withColumn("share", F.col("_all") / F.col("_total"))
        .groupBy("block")
        .agg(F.first("base").alias("base"), F.collect_list(F.struct("source", "share", (F.col("share") * F.col("base") - F.col("before")).alias("deficit"))).alias("deficits"))
    )
    return owed


def drr(queues: dict, shares: dict, deficits: dict, room: int, window: int, quantum: int) -> Iterator[tuple]:
    """Deficit round-robin: yields ``(source, document, start, length)`` until all queues are empty.

    ``queues``: documents of a source as ``[document, length]``. In each round every waiting source earns its share of a
    window; it sends while its deficit covers ``quantum`` ids or the rest of its document. ``room``: ids that still go
    into the first window. A piece ends with its window, document or quantum, and deficits go on to the next window.
    Where a queue runs dry the others share its part; queues without a share go last, evenly.
    """
    order = sorted(queues, key=lambda s: (s is None, s or ""))
    total = sum(shares[s] for s in order)
    while order:
        if not total:
            shares, total = dict.fromkeys(order, 1.0), float(len(order))
        for source in order:
            queue = queues[source]
            deficits[source] += window * shares[source] / total
            while queue:
                item = queue[0]  # document, length, sent
                want = min(quantum, item[1] - item[2])
                if deficits[source] < want:
                    break
                sent = 0
                while sent < want:
                    n = min(want - sent, room)
                    yield source, item[0], item[2], n
                    item[2] += n
                    sent += n
                    room = room - n or window
                deficits[source] -= want
                if item[2] == item[1]:
                    queue.popleft()
        if any(not queues[s] for s in order):
            order = [s for s in order if queues[s]]
            total = sum(shares[s] for s in order)


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, quantum: int = 512, block_tokens: int = 1 << 20, most_broadcast: int = 100_000, targets: Mapping[str | None, float] | None = None) -> DataFrame:
    """Pieces of all documents in sequences of ``window`` ids: ``doc_id start length ids_crc32 doc_tokens sequence_id offset``.

    A document is its ids (null text: none) and ``end_id``. Sources (null is one) get their part of ``targets`` (by
    default, their share of the corpus; a source that is not named has none) in every run of windows, as long as the
    block has ids of all: every id is packed, so when a source runs dry the others fill its part, and sources without a
    target come last. Documents are dealt evenly into blocks, and each block serves its source queues by :func:`drr`,
    starting with the deficits that the blocks before it left. A block's first window goes on where the last block
    ended, so all sequences are full but the very last, and no row moves again after the deal. Pieces have
    ``quantum`` ids unless a document or window ends earlier; neighbouring pieces of one document are joined.
    Repeated rows are documents of their own; an empty table gives no piece; other columns are not read.
    Block starts are broadcast up to ``most_broadcast`` (block, source) pairs and joined by shuffle beyond.
    """
    blocks = written(tokenized_blocks(docs, tokenizer_path, end_id, block_tokens), "pack-blocks")
    starts = written(block_starts(blocks), "pack-starts")
    if (starts.agg(F.sum(F.size("deficits"))).first()[0] or 0) <= most_broadcast:
        starts = F.broadcast(starts)

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                base, owed, doc_ids, sources, lengths, ids = (batch.column(c)[row].as_py() for c in ("base", "deficits", "doc_ids", "sources", "lengths", "ids"))
                ids, ends = memoryview(ids), np.cumsum(lengths).tolist()
                queues: dict = {}
                for i, source in enumerate(sources):
                    queues.setdefault(source, deque()).append([i, lengths[i], 0])
                deficits = {x["source"]: x["deficit"] for x in owed}
                shares = {x["source"]: x["share"] if targets is None else float(targets.get(x["source"], 0.0)) for x in owed}
                pieces, at = [], base
                for _, i, start, n in drr(queues, shares, deficits, window - base % window, window, quantum):
                    last = pieces[-1] if pieces else None
                    if last and last[0] == i and last[1] + last[2] == start and at % window:
                        last[2] += n
                    else:
                        pieces.append([i, start, n, at])
                    at += n
                out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
                for i, start, n, at in pieces:
                    first = ends[i] - lengths[i] + start
                    for k, v in zip(out, (doc_ids[i], start, n, zlib.crc32(ids[4 * first : 4 * (first + n)]), lengths[i], at // window, at % window), strict=True):
                        out[k].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], list(out))

    return blocks.drop("n", "per_source").join(starts, "block").mapInArrow(serve, PIECE)
