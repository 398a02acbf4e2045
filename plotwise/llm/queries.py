"""The thin queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotrain, langid, lines, mixing, packing, quality_rules, simhash, suffix, tokens, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target of the quality rules: documents labelled as good."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), trusted(spark, sf_dir)).drop("text")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixing_plan(table(spark, sf_dir, "documents"), narrow=True)
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = suffix.repeated_spans(table(spark, sf_dir, "documents"))
    return spans.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.md5("text").alias("kept_md5"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_mixing, op3_simhash, op4_topk, op5_suffix_dedup, op6_token_counts, op7_line_dedup, op8_packing, op9_language_id, op10_quality_classifier)}

ORACLES = {
    "op2_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS m,
  row_number() OVER (PARTITION BY doc_id, md5(coalesce(text, '')), source) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS weight FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY source_size * 2.0 / weight, source NULLS LAST) AS n FROM w),
lines AS (SELECT a.n, (SELECT 3 * sum(source_size) FROM l) - 4 * coalesce((SELECT sum(b.source_size) FROM l b WHERE b.n < a.n), 0) AS rest, (SELECT sum(b.weight) FROM l b WHERE b.n >= a.n) AS weights, a.weight, a.source_size FROM l a),
line AS (SELECT rest, weights FROM lines WHERE rest * weight <= 4 * source_size * weights ORDER BY n LIMIT 1),
t AS (SELECT l.source, l.source_size, least(coalesce(CAST((SELECT rest FROM line) * l.weight AS DOUBLE) / CAST(2 * (SELECT weights FROM line) AS DOUBLE), 1e300), CAST(2 * l.source_size AS DOUBLE)) AS target FROM l),
r AS (SELECT d.doc_id, d.source, d.m, d.place, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 2.0) ELSE 0.0 END AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN CAST(CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || m || ':' || coalesce(source, '') || ':' || CAST(place AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r""",
    "op7_line_dedup": r"""
WITH d AS (SELECT doc_id, text, md5(text) AS m, string_split(text, chr(10)) AS l FROM documents),
h AS (SELECT DISTINCT doc_id, m, l, i, l[i] AS line, CAST('0x' || substr(md5(l[i]), 1, 8) AS BIGINT) AS x FROM d, unnest(range(1, len(l) + 1)) AS t(i) WHERE text IS NOT NULL),
e AS (SELECT *, (coalesce(lag(x) OVER w, 0) * 31 + x) % 3 = 0 AS ends FROM h WINDOW w AS (PARTITION BY doc_id, m ORDER BY i)),
k AS (SELECT *, coalesce(sum(CAST(ends AS BIGINT)) OVER (PARTITION BY doc_id, m ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM e),
c AS (SELECT doc_id, m, place, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM k GROUP BY doc_id, m, place),
r AS (SELECT *, n > 1 AND regexp_matches(chunk, '[^\x20\x09-\x0D]') AND row_number() OVER (PARTITION BY chunk, n > 1 ORDER BY doc_id NULLS LAST, m, place) > 1 AS gone FROM c),
o AS (SELECT doc_id, m, CAST(sum(n) AS BIGINT) AS n_lines, CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS n_removed_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed_chunks, md5(coalesce(string_agg(chunk, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_md5 FROM r GROUP BY doc_id, m)
SELECT d.doc_id, coalesce(o.n_lines, 0) AS n_lines, coalesce(o.n_removed_lines, 0) AS n_removed_lines, coalesce(o.n_removed_chunks, 0) AS n_removed_chunks, o.kept_md5
FROM d LEFT JOIN o ON d.doc_id IS NOT DISTINCT FROM o.doc_id AND d.m = o.m""",
    "op4_topk": """
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20""",
}
