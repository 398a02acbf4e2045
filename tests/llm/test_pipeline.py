"""The pipeline's stages one after the other, each against what it may do."""

import collections

import corpus_pipeline
from plotwise.llm import quality_rules, queries, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, held = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        held.append({name: docs.count()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "quality rules":
            verdict = quality_rules.quality_rules(spark.read.parquet(f"{SF}/documents.parquet"), queries.trusted(spark, SF))
            assert {r[0] for r in docs.select("doc_id").collect()} == {r[0] for r in verdict.where("kept").select("doc_id").collect()}
        if name == "simhash near-dedup":
            again = simhash.near_duplicates(docs).collect()
            assert all(r["doc_id"] == r["component_id"] for r in again)
            single = {r[0] for r in docs.select("doc_id").collect()}
        if name == "mixing":
            copies = collections.Counter(r[0] for r in docs.select("doc_id").collect())
            assert set(copies) <= single and max(copies.values()) <= 2
    assert docs.agg({"sequence_id": "max"}).first()[0] is not None
    assert {r[0] for r in docs.select("doc_id").distinct().collect()} == set(copies)
