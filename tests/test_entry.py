"""The driver's contract: every oracle names a query, columns agree, and a query matches its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def rows(values):
    return sorted(tuple("null" if v is None or v != v else round(float(v), 5) if isinstance(v, float) else str(v) for v in r) for r in values)


def test_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", ["rank_groups", "exclusion_ledger", "prep_cluster_matrix", "range_join_neighbors", "ladder_kept", "map_layer_ranked"])
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in ("customer", "nation", "region", "orders"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert rows(df.select(*columns).collect()) == rows(want)
