"""Quality rules: base counts and a hashed n-gram log-likelihood ratio, in DataFrame functions alone."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, guarded, restored, words_of

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
ADDED = [*BASE, "llr", "kept"]
#: A token of the n-gram model: a run of letters, of digits, or of other visible characters.
TOKEN = r"\p{L}+|\p{N}+|[^\p{L}\p{N}\s]+"
SYMBOLS = r"[#*$%&|<>]"


def settled(flag: Column) -> Column:
    """``flag``, never moved: a row number keeps the optimizer from computing it and its columns anew below, once for each use, when rows are filtered by it."""
    return flag & (F.monotonically_increasing_id() >= 0)


def repeat_words(words: Column, hashes: Column) -> Column:
    """Words in three-word windows found twice or more; ``hashes``: one for each window, in order."""
    windows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(sorted_windows: Column) -> Column:
        same = lambda w, i: (F.get(sorted_windows, i - 1)["h"] == w["h"]) | (F.get(sorted_windows, i + 1)["h"] == w["h"])
        return F.sort_array(F.transform(F.filter(sorted_windows, lambda w, i: F.coalesce(same(w, i), F.lit(False))), lambda w: w["i"]))

    # each repeated window adds the words up to the next one, three at most; holding the arrays in lambdas computes them once
    steps = F.transform(F.array(windows), lambda s: F.transform(F.array(repeated(s)), lambda p: F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.aggregate(F.get(F.get(steps, F.lit(0)), F.lit(0)), F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long"))


def base_rules(docs: DataFrame, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """``docs`` with ``BASE``: counts over the whole text, and whether they fail it.

    n_words: words (runs of anything but ASCII white space); word_chars: code points in them; n_symbols: characters of
    ``#*$%&|<>``; n_dup_lines: lines with a word that equal an earlier line; n_repeat_words: words in three-word windows
    that the text holds twice or more. It fails below ``least_words`` words, or if more than ``most_repeated`` percent
    of them are in repeated windows. Null text counts as empty. Rows are independent. Columns of ``docs`` with these
    names are replaced.
    """
    held, names = guarded(docs, {"text"})
    return restored(_base(held, least_words, most_repeated), names, BASE)


def _base(docs: DataFrame, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    hashes = F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    return (
        docs.withColumns({"_words": words_of(F.col("text")), "_lines": lines})
        .withColumns({"n_words": F.size("_words").cast("long"), "word_chars": F.length(F.array_join("_words", "")).cast("long"), "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")})
        .withColumn("_hashes", hashes)
        .withColumn("n_repeat_words", repeat_words(F.col("_words"), F.col("_hashes")))
        .withColumn("base_failed", settled((F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))))
        .drop("_words", "_lines", "_hashes")
    )


def bucket(buckets: int, *tokens: Column) -> Column:
    return F.pmod(F.xxhash64(*tokens), F.lit(buckets)).cast("int")


def with_grams(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_grams``: an array of (token, next token or null)."""
    tokens = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(TOKEN), F.lit(0))
    return docs.withColumn("_a", tokens).withColumn("_b", F.slice("_a", F.lit(2), F.size("_a"))).withColumn("_grams", F.arrays_zip("_a", "_b")).drop("_a", "_b")


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int, smoothing: float, most_broadcast: int) -> list[float]:
    """For each bucket log(p_target / p_raw) of the n-grams that hash into it, over all rows of ``docs``.

    ``trusted``: column ``doc_id``, the ids of the target. Counts are summed in each task before the shuffle, so
    ``buckets`` rows a task move at most, and ``buckets`` numbers come back.
    """
    ids = trusted.select(F.col("doc_id").alias("_trusted")).where(F.col("_trusted").isNotNull()).distinct()
    if ids.count() <= most_broadcast:
        ids = F.broadcast(ids)
    rows = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_trusted"), "left").select("text", F.col("_trusted").isNotNull().cast("long").alias("_t"))
    # outer forms: for the others the optimizer would cut the texts once more to filter out empty arrays
    pairs = with_grams(rows).select("_t", F.inline_outer("_grams"))
    hashed = pairs.select("_t", F.explode_outer(F.array(F.when(F.col("_a").isNotNull(), bucket(buckets, F.col("_a"))), F.when(F.col("_b").isNotNull(), bucket(buckets, F.col("_a"), F.col("_b"))))).alias("_bucket")).where(F.col("_bucket").isNotNull())
    counts = {r[0]: (r[1], r[2]) for r in hashed.groupBy("_bucket").agg(F.sum("_t"), F.count("*")).collect()}
    of_target, of_raw = sum(t for t, _ in counts.values()), sum(n for _, n in counts.values())
    even = smoothing * buckets
    found = (counts.get(b, (0, 0)) for b in range(buckets))
    return [math.log((t + smoothing) / (of_target + even)) - math.log((n + smoothing) / (of_raw + even)) for t, n in found]


def quality_rules(docs: DataFrame, trusted: DataFrame, least_llr: float = -0.3, buckets: int = 10_000, smoothing: float = 1.0, most_broadcast: int = 2_000_000) -> DataFrame:
    """``docs`` with ``BASE``, ``llr`` and ``kept``: the verdict on every document.

    ``llr``: the sum over the document's one- and two-token n-grams, hashed into ``buckets``, of the log ratio between
    the multinomials of the trusted target and of the raw corpus (all of ``docs``), divided by their number (0 without
    any). ``kept``: not ``base_failed``, and ``llr >= least_llr``; there is no draw, so reruns agree. ``trusted`` names
    the target by ``doc_id``; with no target all buckets lean as the raw corpus does and ``llr`` decides little. Null
    text counts as empty. Repeated rows count and repeat. Ids are broadcast up to ``most_broadcast``.
    """
    held, names = guarded(docs, {"doc_id", "text"})
    return restored(_judged(held, trusted, least_llr, buckets, smoothing, most_broadcast), names, ADDED)


def _judged(docs: DataFrame, trusted: DataFrame, least_llr: float = -0.3, buckets: int = 10_000, smoothing: float = 1.0, most_broadcast: int = 2_000_000) -> DataFrame:
    ratios = F.from_json(F.lit(json.dumps(log_ratios(docs, trusted, buckets, smoothing, most_broadcast))), "array<double>")
    of = lambda *tokens: F.get(ratios, bucket(buckets, *tokens))
    total = F.aggregate("_grams", F.lit(0.0), lambda a, g: a + of(g["_a"]) + F.when(g["_b"].isNotNull(), of(g["_a"], g["_b"])).otherwise(F.lit(0.0)))
    n = F.size("_grams")
    scored = with_grams(_base(docs)).withColumn("llr", F.when(n > 0, total / (2 * n - 1)).otherwise(F.lit(0.0)))
    return scored.drop("_grams").withColumn("kept", settled(~F.col("base_failed") & (F.col("llr") >= least_llr)))


def accepted(docs: DataFrame, trusted: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, in the columns of ``docs``."""
    held, names = guarded(docs, {"doc_id", "text"})
    return restored(_judged(held, trusted, **options).where("kept"), names)
