"""The driver's contract, and some queries against their SQL at the smallest size."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(str(x) for x in r) for r in frame.itertuples(index=False))


def test_entry_and_names(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir(SF):
        assert entry.entry(spark).count() == 25


@pytest.mark.parametrize("name", ["community_stats_summary", "structural_metrics", "best_method_counts", "triangle_count", "tune_threshold"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(con.sql(entry.oracle_sql()[name]).df())
