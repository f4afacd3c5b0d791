"""Queries against their SQL, on the smallest tables where they are there."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
QUICK = ("check_digits", "emit_td3", "parse_td1", "pivot_sweep", "blindspots", "country_lookup", "latency_percentiles", "stride_sample", "text_sanity", "job_status", "stream_rates", "integrity_findings")


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    got = entry.queries()[name](spark, DATA)
    cols = sorted(got.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key)
    b = sorted((tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall()), key=key)
    assert a == b
