"""Every scene query gives the rows of its SQL."""

from __future__ import annotations

import os

import duckdb
import pytest

from posegrid.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def text(v) -> str:
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


def rows(columns: list[str], data) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(text(r[k]) for k in order) for r in data)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for n in NAMES:
        con.sql(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_matches_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    wanted = db.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(wanted.columns)
    assert rows(df.columns, got) == rows(wanted.columns, wanted.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
