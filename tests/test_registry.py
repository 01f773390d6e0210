"""Queries run on the smallest tables and agree with DuckDB."""

import os

import pytest

import __spark_entry__ as entry
from lexquarry.plans import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["chunk_stats", "bm25_topk", "knn_graph", "audit_summary", "upsert_keep_created", "das_features", "dataset_aggregate", "xml_sections", "candidate_pages", "page_splice", "token_budget"])
def test_against_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(DIR):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{t}'")
    rel = con.sql(registry.ORACLE[name])
    columns = rel.columns
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    expected = sorted(repr([r[i] for i in order]) for r in rel.fetchall())
    df = registry.QUERIES[name](spark, DIR)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr([r[c] for c in sorted(columns)]) for r in df.collect()) == expected
