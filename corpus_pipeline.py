"""From raw documents to packed sequences, in stages that each work on all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plotwise.llm import lines, mixing, packing, quality_rules, queries, shingles, simhash
from plotwise.llm.common import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.accepted(docs, queries.trusted(spark, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose repeated chunks of lines, and what chunk borders cut of repeated runs; all documents stay."""
    return lines.passage_dedup(docs, divisor=3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, and of those none that is near to an earlier one on shingles."""
    return shingles.without_near(written(simhash.one_of_each(docs), "one-of-each"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them."""
    return mixing.mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; a copy that the mix made is a document of its own."""
    return packing.pack(docs, queries.tokenizer("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("simhash near-dedup", near_dedup), ("mixing", mix), ("packing", pack)]

#: XXH64 and the tokenizer have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
