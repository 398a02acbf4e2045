"""Removal of repeated byte strings, with suffixes sorted by bucket-pointer refinement."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import picked, written

NO_ID = np.iinfo(np.int64).max  # stands for a null id: larger than all others, smaller than none
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SUB_BYTES = 384 << 10  # bytes of texts that a sub-part stands for; the sub-parts of a part are sorted one after the other
RUN = 31  # windows in a run at most: their marks fit 32 bits
CHUNK = 1 << 15  # windows whose keys are made at once
BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("texts", pa.binary())])


class Powers:
    """Powers of BASE and of its inverse modulo 2^64, as many as were asked for yet."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            steps = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)]))
            self.up, self.down = steps(BASE), steps(INVERSE)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def window_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """Hash of each string of ``q`` bytes (unsigned 64 bits), by prefix sums of a polynomial."""
    n = len(data)
    up, down = POWERS.of(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data.astype(np.uint64) * up[:n])])
    h = (sums[q:] - sums[:-q]) * down[: n - q + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    k = 1
    while 2 * k <= w:
        x, k = np.minimum(x[:-k], x[k:]), 2 * k
    return np.minimum(x[: len(x) - (w - k)], x[w - k :]) if k < w else x


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64 bits, whose high bits depend on all."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def window_keys(data: np.ndarray, length: int, q: int) -> np.ndarray:
    """For each window of ``length`` bytes the least hash of a q-gram in it, mixed again as minima are small: equal windows have equal keys."""
    return mixed(sliding_min(window_hashes(data, q), length - q + 1))


Q = 8  # bytes of the initial buckets
SLICES = 16  # slices of the buckets, refined one after the other


def leading_words(data: np.ndarray) -> np.ndarray:
    """The ``Q`` bytes that begin at each place, zeros after the end, as numbers in the order of the bytes."""
    padded = np.concatenate([data, np.zeros(Q - 1, np.uint8)])
    return np.ndarray(len(data), f">u{Q}", padded, strides=(1,)).astype(np.uint64)


def suffix_order(words: np.ndarray, length: int) -> np.ndarray:
    """The places of a text in the order of their suffixes' first ``length`` bytes at least; ``words``: :func:`leading_words`.

    Bucket-pointer refinement. Suffixes are put in buckets by their first ``Q`` bytes; each suffix points to its bucket
    (the bucket's last place in the order) and knows how many bytes the bucket shares. A bucket is refined by sorting on
    the pointers at the offset where its shared bytes end, and its pointers are set anew at once. Slices of buckets
    are refined one after the other, each again and again until it is done, so that a later slice finds the pointers
    of earlier ones in their final, deep buckets and needs few sorts. Suffixes alone in a bucket are not sorted again.
    """
    n = len(words)
    order = np.argsort(words)
    pointer, shared = np.empty(n, np.int64), np.full(n, Q, np.int64)

    def bucketed(keys: np.ndarray, at: np.ndarray, members: np.ndarray) -> np.ndarray:
        """Sets the pointers of ``members``, which are at the places ``at``; equal keys: one bucket. Says which share one."""
        last = np.flatnonzero(np.concatenate([keys[1:] != keys[:-1], [True]]))
        sizes = np.diff(np.concatenate([[-1], last]))
        pointer[members] = at[np.repeat(last, sizes)]
        return np.repeat(sizes > 1, sizes)

    if not n:
        return order
    open_ = np.flatnonzero(bucketed(words[order], np.arange(n), order) & (length > Q))
    if not len(open_):
        return order
    # cuts between buckets, so that no bucket is in two slices
    heads = np.flatnonzero(np.concatenate([[True], np.diff(pointer[order[open_]]) != 0]))
    cuts = np.unique(heads[np.linspace(0, len(heads), SLICES, endpoint=False).astype(int)])
    for at in np.split(open_, cuts[1:]):
        while len(at):
            members = order[at]
            target = members + shared[members]
            inside = target < n
            target = np.minimum(target, n - 1)
            keys = pointer[members] * (n + 1) + np.where(inside, pointer[target] + 1, 0)
            by_key = np.argsort(keys)
            reached = np.where(inside, shared[target], 0)
            order[at] = members = members[by_key]
            shared[members] += reached[by_key]
            several = bucketed(keys[by_key], at, members)
            at = at[several & (shared[members] < length)]
    return order


def refined(data: np.ndarray, length: int, places: np.ndarray | None = None) -> np.ndarray:
    """A number for each of ``places`` (all), the same if and only if the ``length`` bytes from there are (zeros follow the end).

    Equal windows are neighbours in the order of suffixes, so each is compared, byte by byte, with the one before.
    """
    words = leading_words(data)
    n = len(words)
    places = np.arange(n) if places is None else places
    order = suffix_order(words, length)
    asked = np.full(n, -1)
    asked[places] = np.arange(len(places))
    by = asked[order]
    by = by[by >= 0]
    at, padded = places[by], np.concatenate([words, np.zeros(length, np.uint64)])
    same = np.ones(max(len(at) - 1, 0), bool)
    for offset in range(0, length, Q):
        there = padded[at + min(offset, max(length - Q, 0))] >> np.uint64(8 * max(0, Q - length))
        same &= there[1:] == there[:-1]
    classes = np.empty(len(places), np.int64)
    classes[by] = np.concatenate([np.zeros(min(len(at), 1), np.int64), np.cumsum(~same)])
    return classes


def marks_of(strings: list[bytes], least: np.ndarray, length: int) -> np.ndarray:
    """For each string a bit a window, set if another string with a smaller id than its ``least`` has the window too."""
    kinds: dict[bytes, int] = {}
    names = np.array([kinds.setdefault(x, len(kinds)) for x in strings])
    lows = np.full(len(kinds), NO_ID)
    np.minimum.at(lows, names, least)
    widths = np.array([len(k) for k in kinds]) - length + 1
    ends = np.cumsum(widths)
    owner = np.repeat(np.arange(len(widths)), widths)
    # places of the windows in the joined strings, each of which has length - 1 places more than windows
    places = np.arange(ends[-1]) + owner * (length - 1)
    bucket = refined(np.frombuffer(b"".join(kinds), np.uint8), length, places)
    low = np.full(bucket.max() + 1, NO_ID)
    np.minimum.at(low, bucket, lows[owner])
    low = low[bucket]
    own = np.repeat(np.arange(len(names)), widths[names])
    begins = np.cumsum(widths[names]) - widths[names]
    shift = np.arange(len(own)) - begins[own]
    marks = (low[(ends - widths)[names][own] + shift] < least[own]).astype(np.uint32) << shift.astype(np.uint32)
    return np.add.reduceat(marks, begins, dtype=np.uint32)


def parts_of(total: int, part_bytes: int, many_parts: int) -> tuple[int, int]:
    """How many parts there are for texts of ``total`` bytes, and how many sub-parts a part has."""
    parts = max(1, -(-total // part_bytes))
    parts = max(min(parts, many_parts), -(-parts // 4))
    return parts, max(1, min(256, -(-total // (parts * SUB_BYTES))))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Part of a key; larger keys are in later parts."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


class Block:
    """The documents of a block row, one after the other, and the runs of their windows: of one document and one key each."""

    def __init__(self, row: dict, length: int, q: int):
        self.ids = np.array([NO_ID if x is None else x for x in row["doc_ids"]], np.int64)
        self.raw = zstandard.ZstdDecompressor().decompress(row["texts"])
        self.whole = np.frombuffer(self.raw, np.uint8)
        self.ends = np.cumsum([0, *row["lengths"]])
        self.length = length
        lasts = np.maximum(self.ends[1:] - length + 1, self.ends[:-1])  # where the windows of a document end
        starts, least = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        heads, before = self.ends[:-1][lasts > self.ends[:-1]], None
        for lo in range(0, len(self.whole) - length + 1, CHUNK):
            low = sliding_min(window_hashes(self.whole[lo : lo + CHUNK + length - 1], q), length - q + 1)
            new = np.empty(len(low), bool)
            new[0], new[1:] = low[0] != before, low[1:] != low[:-1]
            a, b = np.searchsorted(heads, [lo, lo + len(low)])
            new[heads[a:b] - lo] = True
            at = np.flatnonzero(new)
            starts.append(at + lo)
            least.append(low[at])
            before = low[-1]
        starts, least = np.concatenate(starts), np.concatenate(least)
        doc = np.searchsorted(self.ends, starts, side="right") - 1
        sizes = np.minimum(np.append(starts[1:], len(self.whole)), lasts[doc]) - starts
        held = np.flatnonzero(sizes > 0)  # the others are windows over the end of a document
        self.doc, self.starts, self.sizes = doc[held], starts[held], sizes[held]
        keys = mixed(least[held])
        order = np.argsort(keys)
        new = np.concatenate([[True], np.diff(keys[order]) != 0])[: len(keys)]
        self.firsts, self.order = np.flatnonzero(new), order
        self.known = keys[order[self.firsts]]
        self.key = np.empty(len(keys), np.int64)  # the place of a run's key among the distinct ones
        self.key[order] = np.cumsum(new) - 1

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys in order, and whether documents of different ids have each."""
        if not len(self.known):
            return self.known, np.zeros(0, bool)
        owner = self.ids[self.doc[self.order]]
        return self.known, np.minimum.reduceat(owner, self.firsts) != np.maximum.reduceat(owner, self.firsts)

    def strings(self, state: np.ndarray, parts: int, subs: int) -> tuple[dict, dict]:
        """Runs of windows whose key is shared (state 1) or common (2), and their distinct strings, in the order of parts.

        Runs: the documents ``doc``, the first windows ``at``, how many ``n``, their strings ``kind``. Strings: ``text``, the
        least id ``least`` and ``sub``, the number among the sub-parts of all parts. Windows of a common key go alone,
        under a hash of the window. Equal strings have equal keys, so they are in one sub-part.
        """
        now = state[self.key]
        some = np.flatnonzero(now)
        each = np.where(now[some] == 1, RUN, 1)
        cuts = -(-self.sizes[some] // each)
        run, step = np.repeat(some, cuts), np.repeat(each, cuts)
        nth = np.arange(len(run)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        at = self.starts[run] + nth * step
        n = np.minimum(self.sizes[run] - nth * step, step)
        keys = self.known[self.key[run]]
        alone = np.flatnonzero(now[run] == 2)
        for lo in range(0, len(alone), CHUNK // 4):
            part = alone[lo : lo + CHUNK // 4]
            keys[part] = window_hashes(self.whole[at[part][:, None] + np.arange(self.length)].ravel(), self.length)[:: self.length]
        raw, kinds = self.raw, {}
        kind = np.array([kinds.setdefault(raw[a:b], len(kinds)) for a, b in zip(at.tolist(), (at + n + self.length - 1).tolist(), strict=True)], np.int64)
        sub, least = np.empty(len(kinds), np.int64), np.full(len(kinds), NO_ID)
        sub[kind] = part_of(keys, parts * subs)
        np.minimum.at(least, kind, self.ids[self.doc[run]])
        order = np.argsort(sub, kind="stable")
        place, text = np.empty(len(kinds), np.int64), list(kinds)
        place[order] = np.arange(len(order))
        return {"doc": self.doc[run], "at": at, "n": n, "kind": place[kind]}, {"text": [text[i] for i in order.tolist()], "least": least[order], "sub": sub[order]}


def states(block: Block, replies: list[dict], parts: int) -> np.ndarray:
    """The state of each of the block's distinct keys, from the replies of the parts."""
    state, part = np.zeros(len(block.known), np.uint8), part_of(block.known, parts)
    for x in replies:
        a, b = np.searchsorted(part, [x["part"], x["part"] + 1])
        state[a:b] = np.frombuffer(x["reply"], np.uint8)
    return state


def covered(block: Block, runs: dict, marks: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The bytes of the block that go; ``marks``: the bits of each string's windows that smaller documents of any block have."""
    # a string that a smaller document of the block has is gone as a whole
    every = (np.int64(1) << runs["n"]) - 1
    mask = np.where(block.ids[runs["doc"]] > least[runs["kind"]], every, marks[runs["kind"]].astype(np.int64))
    change, full = np.zeros(len(block.whole) + 1, np.int32), mask == every
    np.add.at(change, runs["at"][full], 1)
    np.add.at(change, (runs["at"] + runs["n"] + block.length - 1)[full], -1)
    some = np.flatnonzero(~full & (mask > 0))
    for w in range(RUN):
        at = runs["at"][some[mask[some] >> w & 1 > 0]] + w
        np.add.at(change, at, 1)
        np.add.at(change, at + block.length, -1)
    return np.cumsum(change[:-1], dtype=np.int32) > 0


def repeated_spans(docs: DataFrame, length: int = 50, q: int = 20, block_bytes: int = 4 << 20, part_bytes: int = 6 << 20, common_blocks: int = 1024, many_parts: int = 512) -> DataFrame:
    """``doc_id n_bytes spans kept`` for every row of ``docs``: what a smaller document holds too, and the bytes that stay.

    Texts are UTF-8 bytes (null: empty). A byte goes if a string of ``length`` bytes that covers it also starts in a
    document with a smaller ``doc_id``; strings overlap and are judged on the input. ``spans``: maximal removed runs
    ``(start, end)``. A null id is larger than all others; rows of equal id take nothing from each other; texts shorter
    than ``length`` lose nothing; an empty table gives no row. ``length`` is at least ``q`` and below 65,000.

    Every window of ``length`` bytes is filed under the least hash of its q-grams. (1) Blocks of texts send their
    distinct keys, 6 bytes each, to parts, which answer for which keys other documents have too. (2) For these, runs of windows
    of one key go as strings, once a block with the block's least id, to the key's part, where :func:`suffix_order` sorts
    their suffixes and each window gets the least id that has it; the answer is a bit a window. (3) Blocks mark their
    documents. Keys that more than ``common_blocks`` blocks have are split: their windows go to parts of their own hash.
    What a block sends or gets is bounded by its own size, and a part gets a key's string once a block at most. A block
    sends a row a part; so parts grow, up to four times ``part_bytes``, before there are more than ``many_parts``.
    Texts are kept compressed in a written table and move twice, joined with the answers.
    """
    if not q <= length < 65_000:
        raise ValueError("length must be at least q and below 65,000")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, held, size = TaskContext.get().partitionId() << 32, 0, [], 0
        press = zstandard.ZstdCompressor(level=3)

        def block() -> pa.RecordBatch:
            row = {"block": first + made, "doc_ids": [d for d, _ in held], "lengths": [len(t) for _, t in held], "texts": press.compress(b"".join(t for _, t in held))}
            return pa.RecordBatch.from_pylist([row], schema=BLOCK_SCHEMA)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((doc_id, (text or "").encode()))
                size += len(held[-1][1])
                if size >= block_bytes or len(held) >= 1 << 16:
                    yield block()
                    made, held, size = made + 1, [], 0
        if held:
            yield block()

    rows = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    blocks = written(rows.mapInArrow(cut, "block long, doc_ids array<long>, lengths array<int>, texts binary"), "suffix-blocks")
    total = blocks.select(F.explode("lengths").alias("n")).agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    parts, subs = parts_of(total, part_bytes, many_parts)
    spread = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts // 4)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                known, several = Block(row, length, q).distinct()
                if not len(known):
                    continue
                part, short = part_of(known, parts), known.view(np.uint8).reshape(-1, 8)[:, 2:]
                at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                ends = np.concatenate([at[1:], [len(part)]])
                yield pa.RecordBatch.from_pydict({"part": part[at], "block": np.full(len(at), row["block"]), "keys": pa.array([short[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()), "several": pa.array([np.packbits(several[a:b]).tobytes() for a, b in zip(at, ends, strict=True)], pa.binary())})

    def answer_keys(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.uint8).reshape(-1, 6) for x in table.column("keys").to_pylist()]
        sizes = [len(x) for x in lists]
        wide = np.zeros((sum(sizes), 8), np.uint8)
        wide[:, :6] = np.concatenate(lists)
        _, at, counts = np.unique(wide.view("<u8").ravel(), return_inverse=True, return_counts=True)
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table.column("several").to_pylist(), sizes, strict=True)])
        shared = (counts > 1) | (np.bincount(at, several) > 0)
        state = np.where(shared, np.where(counts > common_blocks, 2, 1), 0).astype(np.uint8)[at]
        cuts = np.cumsum(sizes)[:-1]
        return pa.table({"block": table.column("block"), "part": table.column("part"), "reply": pa.array([x.tobytes() for x in np.split(state, cuts)], pa.binary())})

    asked = blocks.mapInArrow(keys, "part long, block long, keys binary, several binary")
    replies = asked.repartition(spread, "part").groupBy("part").applyInArrow(answer_keys, "block long, part long, reply binary")
    replies = written(replies.groupBy("block").agg(F.collect_list(F.struct("part", "reply")).alias("keys")), "suffix-keys")
    ready = blocks.join(replies, "block")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                block = Block(row, length, q)
                _, found = block.strings(states(block, row["keys"], parts), parts, subs)
                if not found["text"]:
                    continue
                part, sub = found["sub"] // subs, (found["sub"] % subs).astype(np.uint8)
                sizes = np.array([len(t) for t in found["text"]], "<u2")
                at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                cuts = list(zip(at.tolist(), [*at[1:].tolist(), len(part)], strict=True))
                lists = [[x[a:b].tobytes() for a, b in cuts] for x in (sub, sizes, found["least"])]
                lists.append([press.compress(b"".join(found["text"][a:b])) for a, b in cuts])
                yield pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array(np.full(len(at), row["block"])), *[pa.array(x, pa.binary()) for x in lists]], ["part", "block", "subs", "sizes", "least", "strings"])

    def answer_strings(table: pa.Table) -> pa.Table:
        sizes = [np.frombuffer(x, "<u2").astype(np.int64) for x in table.column("sizes").to_pylist()]
        which = np.frombuffer(b"".join(table.column("subs").to_pylist()), np.uint8)
        least = np.frombuffer(b"".join(table.column("least").to_pylist()), "<i8")
        whole = b"".join(zstandard.ZstdDecompressor().decompress(x) for x in table.column("strings").to_pylist())
        ends = np.cumsum(np.concatenate(sizes))
        starts, masks = ends - np.concatenate(sizes), np.zeros(len(which), np.uint32)
        order = np.argsort(which, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(which[order])) + 1):
            masks[at] = marks_of([whole[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], least[at], length)
        cuts = np.cumsum([len(x) for x in sizes])[:-1]
        return pa.table({"block": table.column("block"), "part": table.column("part"), "marks": pa.array([x.tobytes() for x in np.split(masks, cuts)], pa.binary())})

    sent = ready.mapInArrow(strings, "part long, block long, subs binary, sizes binary, least binary, strings binary")
    marks = sent.repartition(spread, "part").groupBy("part").applyInArrow(answer_strings, "block long, part long, marks binary")
    marks = marks.groupBy("block").agg(F.collect_list(F.struct("part", "marks")).alias("marks"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                block = Block(row, length, q)
                gone = np.zeros(len(block.whole), bool)
                if row["marks"]:
                    runs, found = block.strings(states(block, row["keys"], parts), parts, subs)
                    marks, part = np.zeros(len(found["sub"]), np.uint32), found["sub"] // subs
                    for x in row["marks"]:
                        a, b = np.searchsorted(part, [x["part"], x["part"] + 1])
                        marks[a:b] = np.frombuffer(x["marks"], "<u4")
                    gone = covered(block, runs, marks, found["least"])
                # a run of removed bytes ends with its document
                edge, head = np.zeros(len(gone) + 1, bool), np.zeros(len(gone) + 1, bool)
                edge[:-1], head[block.ends] = gone, True
                first = np.flatnonzero(edge[:-1] & (head[:-1] | ~np.concatenate([[False], edge[:-1]])[:-1]))
                last = np.flatnonzero(edge[:-1] & (head[1:] | ~edge[1:])) + 1
                doc = np.searchsorted(block.ends, first, side="right") - 1
                offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(block.ids)))])
                places = pa.StructArray.from_arrays([pa.array(first - block.ends[doc], pa.int64()), pa.array(last - block.ends[doc], pa.int64())], ["start", "end"])
                left = np.concatenate([[0], np.cumsum(~gone)])[block.ends]
                kept = pa.BinaryArray.from_buffers(pa.binary(), len(block.ids), [None, pa.py_buffer(left.astype(np.int32)), pa.py_buffer(block.whole[~gone])])
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["lengths"], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), places), kept], ["doc_id", "n_bytes", "spans", "kept"])

    return blocks.join(replies, "block", "left").join(marks, "block", "left").mapInArrow(finish, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
