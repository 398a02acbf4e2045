"""Quality classifier by co-training of a text view and a page-metadata view."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import guarded, once, picked, written

WORDS, DOC_BITS, META = 1 << 15, 1 << 10, 1 << 12
META_COLUMNS = ("source", "lang", "n_chars", "url")
#: Runs of capitals, of other letters and of digits; each becomes the mark of its group.
RUNS, MARKS = re.compile(r"([A-ZÀ-ÖØ-Þ]+)|([^\W\d_A-ZÀ-ÖØ-Þ]+)|(\d+)"), ("", "A", "a", "0")
#: Log odds lie between -REACH and REACH and are counted in steps of 1 / STEPS.
REACH, STEPS = 30, 64
#: Rows of one matrix product.
SLICE = 256
FEATURES = "doc_id long, y int, size long, at binary, n binary, whole binary, meta binary"


def hashed(text: str, size: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % size


class WordFeatures(dict):
    """Of a word, in one number: the hash of its letters (low 32 bits), and that of its shape (the rest).

    A shape has a mark for each run of capitals, of other letters and of digits; other characters stay. Words of up to 64
    characters are remembered, 300,000 at a time.
    """

    def __missing__(self, word: str) -> int:
        plain = word.isascii() and word.isalpha() and word.islower()
        shape = "a" if plain else RUNS.sub(lambda run: MARKS[run.lastindex], word)
        out = hashed("w" + word.lower(), WORDS) | WORDS + hashed("s" + shape, WORDS) << 32
        if len(word) <= 64:
            if len(self) > 300_000:
                self.clear()
            self[word] = out
        return out


def whole_features(text: str | None, words: list[str]) -> list[int]:
    """Features of a text as a whole, in steps: distinct words and word pairs, word length, distinct lines, length."""
    n = len(words) or 1
    lines = [x for x in (text or "").split("\n") if x.strip()]
    whole = {
        "distinct": 10 * len(set(words)) // n,
        "pairs": 10 * len(set(zip(words, words[1:]))) // n,
        "length": sum(map(len, words)) // n,
        "lines": 10 * len(set(lines)) // (len(lines) or 1),
        "words": n.bit_length(),
    }
    return [hashed(f"{k}={v}", DOC_BITS) for k, v in whole.items()]


def meta_features(row: dict) -> list[int]:
    """Features of the page's metadata; a null is a value of its own, numbers count in powers of two."""
    say = lambda v: "none" if v is None else str(v) if isinstance(v, str) else f"2^{int(abs(v)).bit_length()}"
    pairs = [f"{k}={say(v)}" for k, v in row.items()]
    return [hashed(p, META) for p in [*pairs, "&".join(pairs)]]


class View:
    """Naive Bayes over hashed features, from counts a label; a group's score is the mean log odds of its features."""

    def __init__(self, sizes: tuple[int, ...]):
        self.counts = [np.ones((2, size)) for size in sizes]

    def odds(self) -> list[np.ndarray]:
        shares = [np.log(c / c.sum(axis=1, keepdims=True)) for c in self.counts]
        return [x[1] - x[0] for x in shares]


class Rows:
    """Features of a slice of rows, as arrays: sparse word counts, and a fixed number of others a row."""

    def __init__(self, size: list, at: list, n: list, whole: list, meta: list):
        self.size = np.array(size, np.int64)
        self.at, self.n = np.frombuffer(b"".join(at), "<u2").astype(np.int64), np.frombuffer(b"".join(n), "<u4").astype(float)
        self.row = np.repeat(np.arange(len(size)), self.size)
        self.total = np.maximum(np.bincount(self.row, self.n, len(size)), 1)
        self.whole = np.frombuffer(b"".join(whole), "<u2").astype(np.int64).reshape(len(size), -1)
        self.meta = np.frombuffer(b"".join(meta), "<u2").astype(np.int64).reshape(len(size), -1)

    def text_scores(self, odds: list[np.ndarray]) -> np.ndarray:
        words = np.bincount(self.row, odds[0][self.at] * self.n, len(self.size)) / self.total
        return np.column_stack([words, odds[1][self.whole].mean(axis=1)])

    def meta_scores(self, odds: list[np.ndarray]) -> np.ndarray:
        return odds[0][self.meta].mean(axis=1)[:, None]

    def add_to(self, counts: dict[str, list[np.ndarray]], view: str, rows: np.ndarray, y: int) -> None:
        """Adds the features of the rows that the mask names to the counts of label ``y``."""
        if view == "text":
            words = rows[self.row]
            counts["text"][0][y] += np.bincount(self.at[words], self.n[words], 2 * WORDS)
            counts["text"][1][y] += np.bincount(self.whole[rows].ravel(), minlength=DOC_BITS)
        else:
            counts["meta"][0][y] += np.bincount(self.meta[rows].ravel(), minlength=META)


SIZES = {"text": (2 * WORDS, DOC_BITS), "meta": (META,)}
OTHER = {"text": "meta", "meta": "text"}


def slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Rows]]:
    for lo in range(0, batch.num_rows, SLICE):
        part = batch.slice(lo, SLICE)
        yield part, Rows(*[part.column(c).to_pylist() for c in ("size", "at", "n", "whole", "meta")])


def calibrated(scores: np.ndarray, labels: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a logistic regression on standardised scores (the last: intercept), by Newton's method."""
    x = np.hstack([scores, np.ones((len(scores), 1))])
    w, keep = np.zeros(x.shape[1]), np.diag([ridge] * scores.shape[1] + [1e-3])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -REACH, REACH)))
        grad, hess = x.T @ (p - labels) + keep @ w, (x * (p * (1 - p))[:, None]).T @ x + keep
        w = w - np.linalg.solve(hess, grad)
    return w


def logit(scores: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(scores @ w[:-1] + w[-1], -REACH, REACH)


def spread(doc_ids: list, seed: int) -> np.ndarray:
    """Uniform numbers in [0, 1) that depend on the ids alone; they part rows of one step of odds."""
    return np.array([zlib.crc32(f"{seed}:{i}".encode()) for i in doc_ids], float) / 2**32


def given(rows: Rows, doc_ids: list, rounds: list[dict]) -> Iterator[dict]:
    """Of each round: for each view its log odds of the rows, the rows still free, and those it gives as 0 and as 1.

    A round holds each view's odds, weights and cuts; a view without cuts yet gives nothing. A row is given to a view
    once, by the first round that is sure of it.
    """
    free = {v: np.ones(len(doc_ids), bool) for v in OTHER}
    for k, model in enumerate(rounds):
        out = {}
        for view in OTHER:
            odds, weights, cuts = model[view]
            sure = logit(getattr(rows, f"{view}_scores")(odds), weights)
            step, open_, gives = np.floor(sure * STEPS).astype(int), free[view].copy(), []
            for y, cut in enumerate(cuts or ()):
                beyond = step > cut[0] if y else step < cut[0]
                gives.append(open_ & (beyond | (step == cut[0]) & (spread(doc_ids, k) < cut[1])))
                free[view] &= ~gives[-1]
            out[view] = step, open_, gives
        yield out


def cut_of(steps: dict[int, int], most: float, y: int, sure: float) -> tuple[int, float]:
    """The step at which the surest rows reach ``most``, and the part of that step's rows that still go."""
    least = round(sure * STEPS)
    for step in sorted((s for s in steps if (s >= least if y else s < -least)), reverse=bool(y)):
        if steps[step] > most:
            return step, most / steps[step]
        most -= steps[step]
    return (least - 1 if y else -least), 0.0


def exchanged(pool: DataFrame, views: dict[str, View], check: Rows, y: np.ndarray, rounds: int, share: float, sure: float) -> None:
    """Adds to ``views``, round by round, the features of the pool's rows that the other view is sure of.

    In each round both views score every row of the pool, calibrated on the labelled rows ``check`` that they are not fitted
    on; the surest ``share`` of all rows, in the proportion of the labels, go with their label to the other view, if their
    log odds are beyond ``sure``. Steps of the odds are counted, and given rows' features added up, on
    the executors: the driver gets one row a step, and one a feature and label.
    """
    sc, rate, total, models = pool.sparkSession.sparkContext, float(y.mean()), None, []
    for _ in range(rounds):
        model = {}
        for view in views:
            odds = views[view].odds()
            model[view] = [odds, calibrated(getattr(check, f"{view}_scores")(odds), y), None]
        models.append(model)
        shared = sc.broadcast(models)

        def steps_of(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            seen = Counter()
            for part, rows in (x for batch in batches for x in slices(batch)):
                for view, (step, open_, _) in list(given(rows, part.column("doc_id").to_pylist(), shared.value))[-1].items():
                    seen.update((view, int(s)) for s in step[open_])
            yield pa.RecordBatch.from_pydict({"view": pa.array([v for v, _ in seen], pa.string()), "step": pa.array([s for _, s in seen], pa.int32()), "n": pa.array(list(seen.values()), pa.int64())})

        counted = {v: {} for v in views}
        for r in pool.mapInArrow(steps_of, "view string, step int, n long").groupBy("view", "step").agg(F.sum("n").alias("n")).collect():
            counted[r["view"]][r["step"]] = r["n"]
        total = sum(counted["text"].values()) if total is None else total
        for view in views:
            model[view][2] = [cut_of(counted[view], share * total * part, label, sure) for label, part in enumerate((1 - rate, rate))]
        shared.unpersist()
        ready = sc.broadcast(models)

        def sums_of(batches: Iterator[pa.RecordBatch], ready=ready) -> Iterator[pa.RecordBatch]:
            counts = {v: [np.zeros((2, size)) for size in SIZES[v]] for v in SIZES}
            for part, rows in (x for batch in batches for x in slices(batch)):
                for view, (_, _, gives) in list(given(rows, part.column("doc_id").to_pylist(), ready.value))[-1].items():
                    for label, which in enumerate(gives):
                        if which.any():
                            rows.add_to(counts, OTHER[view], which, label)
            for view, groups in counts.items():
                for g, sums in enumerate(groups):
                    label, at = np.nonzero(sums)
                    arrays = [pa.array([view] * len(at), pa.string()), pa.array(np.full(len(at), g), pa.int32()), pa.array(label, pa.int32()), pa.array(at, pa.int32()), pa.array(sums[label, at], pa.float64())]
                    yield pa.RecordBatch.from_arrays(arrays, ["view", "g", "label", "at", "n"])

        found = pool.mapInArrow(sums_of, "view string, g int, label int, at int, n double")
        for r in found.groupBy("view", "g", "label", "at").agg(F.sum("n").alias("n")).collect():
            views[r["view"]].counts[r["g"]][r["label"], r["at"]] += r["n"]
        ready.unpersist()


def features_of(docs: DataFrame, names: list[str]) -> DataFrame:
    """FEATURES of ``doc_id _y text`` and the metadata columns ``names``: counts of hashed words, whole text, metadata."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = once(("cotrain-words",), WordFeatures)
        for batch in batches:
            out = {"size": [], "at": [], "n": [], "whole": [], "meta": []}
            metas = zip(*[batch.column(c).to_pylist() for c in names], strict=True) if names else [()] * batch.num_rows
            for text, meta in zip(batch.column("text").to_pylist(), metas, strict=True):
                words = (text or "").split()
                counted = Counter(words)
                both = np.fromiter(map(known.__getitem__, counted), np.int64, len(counted))
                at, place = np.unique(np.concatenate([both & 0xFFFFFFFF, both >> 32]), return_inverse=True)
                n = np.bincount(place, np.tile(np.fromiter(counted.values(), float, len(counted)), 2), len(at))
                out["size"].append(len(at))
                out["at"].append(at.astype("<u2").tobytes())
                out["n"].append(n.astype("<u4").tobytes())
                out["whole"].append(np.array(whole_features(text, words), "<u2").tobytes())
                out["meta"].append(np.array(meta_features(dict(zip(names, meta, strict=True))), "<u2").tobytes())
            arrays = [batch.column("doc_id"), batch.column("_y"), pa.array(out["size"], pa.int64()), *[pa.array(out[k], pa.binary()) for k in ("at", "n", "whole", "meta")]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "y", "size", "at", "n", "whole", "meta"])

    return docs.select("doc_id", "_y", "text", *names).mapInArrow(features, FEATURES)


def rows_of(table: list) -> Rows:
    return Rows(*[[r[c] for r in table] for c in ("size", "at", "n", "whole", "meta")])


def quality(docs: DataFrame, labels: DataFrame, most_labelled: int = 4000, rounds: int = 4, share: float = 0.05, sure: float = 3.0, most_broadcast: int = 500_000) -> DataFrame:
    """``doc_id text_score meta_score quality kept`` for every row of ``docs``.

    ``labels``: ``doc_id`` and ``quality`` (1 good, 0 not; other rows and null ids are left out). The text view sees the
    text, the metadata view the columns of META_COLUMNS that ``docs`` has. The views are first fitted on two thirds of at
    most ``most_labelled`` labelled documents, those with the least hash of their id, one row an id (of repeats the least
    features); the last third calibrates. Then they exchange pseudo-labels for ``rounds`` rounds over all unlabelled rows
    (:func:`exchanged`), and all rows of ``docs`` are scored over their whole text: the scores are the calibrated
    probabilities of each view, ``quality`` adds up the log odds of both (their prior once), ``kept`` is ``quality >=
    0.5``. Without labels of both kinds, or with fewer than six labelled documents, every score is the share of good
    labels (0.5 without any label). Features are written once, as a table, and read in each round. More than
    ``most_broadcast`` labels are joined by shuffle. Null texts and metadata are values. Other columns of any name do not
    matter. Rows of one id and one text get one score; repeated rows repeat; an empty table gives no row.
    """
    held, named = guarded(docs, ("doc_id", "text", *META_COLUMNS))
    names = [c for c in META_COLUMNS if any(new == c for _, new in named)]
    held = held.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *names)
    said = picked(labels, "doc_id", "quality").select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y"))
    said = said.where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1)).groupBy("_id").agg(F.max("_y").alias("_y"))
    known = F.broadcast(said) if said.count() <= most_broadcast else said
    table = written(features_of(held.join(known, F.col("doc_id") == F.col("_id"), "left"), names), "cotrain-features")
    order = [F.xxhash64("doc_id", F.lit(42)), "doc_id"]
    chosen = table.where("y is not null").select("doc_id").distinct().orderBy(*order).limit(most_labelled)
    least = F.min(F.struct("size", "at", "n", "whole", "meta", "y")).alias("_least")
    sample = table.where("y is not null").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(least).orderBy(*order).select("_least.*").collect()
    y = np.array([r["y"] for r in sample], float)
    share_good = float(y.mean()) if len(y) else 0.5
    if len(y) < 6 or not 0 < share_good < 1:
        same = F.lit(share_good)
        return table.select("doc_id", same.alias("text_score"), same.alias("meta_score"), same.alias("quality"), F.lit(share_good >= 0.5).alias("kept"))
    return scored(table, fitted(table.where("y is null"), sample, y, rounds, share, sure))


def fitted(pool: DataFrame, sample: list, y: np.ndarray, rounds: int, share: float, sure: float) -> dict:
    """The log odds of both views after the exchange, and their calibration; every third row of ``sample`` calibrates."""
    held = np.arange(len(y)) % 3 == 2
    train, check = (rows_of([r for r, h in zip(sample, held, strict=True) if h == last]) for last in (False, True))
    views = {v: View(SIZES[v]) for v in SIZES}
    for label in (0, 1):
        for view in views:
            train.add_to({view: views[view].counts}, view, y[~held] == label, label)
    exchanged(pool, views, check, y[held], rounds, share, sure)
    model = {"prior": float(np.log(y.mean() / (1 - y.mean())))}
    for view in views:
        odds = views[view].odds()
        model[view] = (odds, calibrated(getattr(check, f"{view}_scores")(odds), y[held]))
    return model


def scored(table: DataFrame, model: dict) -> DataFrame:
    """Scores of all rows of a table of FEATURES."""
    spark: SparkSession = table.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part, rows in (x for batch in batches for x in slices(batch)):
            text, meta = (logit(getattr(rows, f"{v}_scores")(model[v][0]), model[v][1]) for v in SIZES)
            total = text + meta - model["prior"]
            of = lambda x: pa.array(1 / (1 + np.exp(-np.clip(x, -REACH, REACH))))
            arrays = [part.column("doc_id"), of(text), of(meta), of(total), pa.array(total >= 0)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_score", "meta_score", "quality", "kept"])

    return table.mapInArrow(score, "doc_id long, text_score double, meta_score double, quality double, kept boolean")
