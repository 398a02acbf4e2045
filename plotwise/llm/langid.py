"""Language identification by multilingual mixture inference."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once, picked

#: A word, or each part of a longer one (scripts without spaces): what a document mixes.
WORD = re.compile(r"\S{1,16}")
#: Letters by Unicode category (and the marks on them): no superscripts, fractions or letter-like numbers.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
ORDERS = (1, 2, 3, 4)
MOST_WORDS, MOST_LANGS = 300_000, 1_000


def letters_of(word: str) -> str:
    return word.lower() if word.isalpha() else "".join(LETTERS.findall(word)).lower()


def held_out(doc_id: Column) -> Column:
    """Whether a document may not be learned from: crc32 of its id as text is 2 modulo 4 (a null id: false)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def word_grams(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """``(word, bucket)`` of each n-gram of the letters of each word, in UTF-8 bytes with a mark at both ends, lower case."""
    bare = [letters_of(w).encode() for w in words]
    line = b"".join(b"\x01" + w + b"\x02" for w in bare if w)
    sizes = np.array([len(w) + 2 if w else 0 for w in bare], np.int64)
    data, owner = np.frombuffer(line, np.uint8).astype(np.uint64), np.repeat(np.arange(len(words)), sizes)
    owners, found = [], []
    for n in ORDERS:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, np.uint64)
        for j in range(n):
            h = (h * np.uint64(0x100000001B3)) ^ data[j : len(data) - n + 1 + j]
        h *= np.uint64(0x9E3779B97F4A7C15)
        inside = owner[: len(h)] == owner[n - 1 :]
        owners.append(owner[: len(h)][inside])
        found.append((h[inside] >> np.uint64(33)).astype(np.int64) % buckets)
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owners), np.concatenate(found)


def gram_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """``lang bucket n``: n-grams of all rows of ``docs`` (columns ``lang text``, no nulls), summed in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums = {}, {}

        def emptied() -> None:
            for lang, seen in words.items():
                if seen:
                    owner, bucket = word_grams(list(seen), buckets)
                    sums[lang] = sums.get(lang, 0) + np.bincount(bucket, np.fromiter(seen.values(), np.float64, len(seen))[owner], buckets)
            words.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(WORD.findall(text))
                if sum(map(len, words.values())) > MOST_WORDS:
                    emptied()
        emptied()
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(counts[at].astype(np.int64))})

    return docs.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learned(docs: DataFrame, buckets: int, smoothing: float) -> tuple[list[str], np.ndarray]:
    """Languages, and the log-likelihood of each bucket under each; ``buckets`` numbers a language come to the driver."""
    if docs.select("lang").distinct().limit(MOST_LANGS + 1).count() > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} values of lang: not a language column")
    rows = gram_counts(docs, buckets).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((buckets, len(langs)))
    if langs:
        counts[rows["bucket"], np.searchsorted(langs, rows["lang"])] = rows["n"]
    counts += smoothing
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32)


class Words(dict):
    """Row of a word in a growing table of log-likelihoods (float32, a column a language); row 0: no letter."""

    def __init__(self, model: np.ndarray):
        super().__init__()
        self.model, self.table = model, np.zeros((1 << 12, model.shape[1]), np.float32)
        self.n = 1

    def rows(self, words: list[str]) -> np.ndarray:
        new = list({w for w in words if w not in self})
        if new:
            if self.n + len(new) > max(MOST_WORDS, len(new) + 1):
                self.clear()
                self.n, new = 1, list(set(words))
            owner, bucket = word_grams(new, self.model.shape[0])
            grams = np.bincount(owner, minlength=len(new))
            scores = np.stack([np.bincount(owner, column[bucket], len(new)) for column in self.model.T], axis=1)
            # an n-gram of each order begins at nearly every place: their mean counts each place once
            scores /= len(ORDERS)
            while len(self.table) < self.n + len(new):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[self.n : self.n + len(new)] = scores
            self.update(zip(new, np.where(grams > 0, np.arange(self.n, self.n + len(new)), 0).tolist(), strict=True))
            self.n += len(new)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def mixtures(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, penalty: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Main language and its share in each document.

    ``scores``: log-likelihoods of words, those of a document together. Expectation-maximisation over all languages
    ranks them; then for 1, 2, ... of the best ones it is run again, and the number with the highest likelihood less
    ``penalty * (languages - 1) * log(words + 1)`` is taken. A number is only tried where it could win: the
    log-likelihood is concave in the shares, so at any shares its value and its slope bound it for all others.
    """
    k = scores.shape[1]
    top = scores.max(axis=1)
    likely = np.exp(scores - top[:, None])

    def run(likely: np.ndarray, top: np.ndarray, sizes: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, ...]:
        """Shares, log-likelihood, and the largest slope towards one language less the mean slope."""
        starts, each = np.cumsum(sizes) - sizes, (1 / sizes).astype(np.float32)[:, None]
        for _ in range(rounds):
            part = likely * np.repeat(shares, sizes, axis=0)
            part /= np.maximum(part @ np.ones(k, np.float32), 1e-30)[:, None]
            shares = np.add.reduceat(part, starts, axis=0) * each
        whole = np.maximum((likely * np.repeat(shares, sizes, axis=0)) @ np.ones(k, np.float32), 1e-30)
        fit = np.add.reduceat((np.log(whole) + top).astype(np.float64), starts)
        slope = np.add.reduceat(likely / whole[:, None], starts, axis=0).max(axis=1).astype(np.float64)
        return shares, fit, np.maximum(slope - sizes, 0) + 1e-3 * sizes

    shares, most, gap = run(likely, top, sizes, np.full((len(sizes), k), 1 / k, np.float32))
    most, cost = most + gap, penalty * np.log(sizes + 1)
    order = np.argsort(-shares, axis=1, kind="stable")
    best, score = order[:, 0].copy(), np.ones(len(sizes))
    alone = scores[np.arange(len(scores)), np.repeat(best, sizes)]
    value = np.add.reduceat(alone.astype(np.float64), starts)
    for m in range(2, k + 1):
        at = np.flatnonzero(most - (m - 1) * cost > value)
        if not len(at):
            break
        rows = np.repeat(np.isin(np.arange(len(sizes)), at), sizes)
        held = np.zeros((len(at), k), np.float32)
        np.put_along_axis(held, order[at, :m], 1 / m, axis=1)
        held, fit, _ = run(likely[rows], top[rows], sizes[at], held)
        fit = fit - (m - 1) * cost[at]
        better = fit > value[at]
        won = at[better]
        best[won], score[won], value[won] = held.argmax(axis=1)[better], held.max(axis=1)[better], fit[better]
    return best, np.clip(score, 0, 1)


def identify(docs: DataFrame, buckets: int = 1 << 15, smoothing: float = 0.5, penalty: float = 2.0, rounds: int = 8) -> DataFrame:
    """``doc_id held_out lang_pred score`` for every row of ``docs``.

    Languages are learned from all rows with a text and a ``lang`` that are not held out (:func:`held_out`): hashed
    multinomials over the byte n-grams of their words. A document is a mixture of any number of languages, each word
    (of a long run of letters, each part) from one of them (:func:`mixtures`); ``lang_pred`` is the language with the
    largest share, the first by name on a tie, and ``score`` that share. A null text, or one without a letter, or any
    when nothing was learned, is ``und`` with score 0. Predictions see the text alone. Rows are independent: repeated
    rows repeat (and count twice when learned from); an empty table gives no row. More than MOST_LANGS languages are
    refused.
    """
    docs = picked(docs, "doc_id", "lang", "text")
    known = docs.select("lang", "text", "doc_id").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    langs, model = learned(known.select(F.col("lang").cast("string"), F.col("text").cast("string")), buckets, smoothing)
    shared, name = docs.sparkSession.sparkContext.broadcast((langs, model)), uuid.uuid4().hex

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, model = shared.value
        words = once(("words", name), lambda: Words(model))
        for batch in batches:
            names, shares = ["und"] * batch.num_rows, [0.0] * batch.num_rows

            def settle(group: list, names: list = names, shares: list = shares) -> None:
                tokens = [w for _, t in group for w in t]
                rows = words.rows(tokens)
                doc = np.repeat(np.arange(len(group)), [len(t) for _, t in group])[rows > 0]
                sizes = np.bincount(doc, minlength=len(group))
                some = np.flatnonzero(sizes)
                if len(some):
                    best, score = mixtures(words.table[rows[rows > 0]], (np.cumsum(sizes) - sizes)[some], sizes[some], penalty, rounds)
                    for i, b, s in zip(some.tolist(), best.tolist(), score.tolist(), strict=True):
                        names[group[i][0]], shares[group[i][0]] = langs[b], s

            if langs:
                group, size = [], 0
                for i, text in enumerate(batch.column(2).to_pylist()):
                    if text:
                        group.append((i, WORD.findall(text)))
                        size += len(group[-1][1])
                        if size > 50_000:
                            settle(group)
                            group, size = [], 0
                if group:
                    settle(group)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(shares, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
