"""Every registered query against its SQL twin, on the smallest tables."""

import math

import pytest

import __spark_entry__ as entry
from millrace import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return f"{v + 0.0:.4f}".replace("-0.0000", "0.0000") if isinstance(v, float) else str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    got = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(got.columns)
    assert plain(df.collect(), df.columns) == plain(got.fetchall(), got.columns)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
