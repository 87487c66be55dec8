"""Every registered query against its SQL on the smallest tables."""

import importlib
import os

import pytest

from admira import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_rows_equal_sql(spark, duck, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    rel = duck.sql(catalog.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    place = [rel.columns.index(c) for c in cols]
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[i]) for i in place) for r in rel.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_others_give_rows(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert os.path.isdir("/root/testdata/sf0.001") and entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
