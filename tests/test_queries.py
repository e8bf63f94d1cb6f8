"""Queries with SQL give DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

from caseloom.plans import catalogue

SF = "/root/testdata/sf0.001"
NAMES = [n for n, f in catalogue.QUERIES.items() if f.__module__.endswith(("queries_sources", "queries_views")) or n in ("proximity_pairs", "embedding_shortlist", "embedding_links")]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(catalogue.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
