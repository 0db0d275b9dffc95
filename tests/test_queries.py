"""Every registered query against its SQL, as sets of rows."""

from __future__ import annotations

import math

import duckdb
import pytest

from laminar.plans.registry import ORACLE, QUERIES

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def clean(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(clean(r[k]) for k in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    assert got
    if name in ORACLE:
        rel = con.sql(ORACLE[name])
        assert sorted(rel.columns) == sorted(df.columns)
        want = rows(rel.columns, rel.fetchall())
        assert len(got) == len(want)
        assert got == want
