"""Corpus queries that SQL can express, side by side with it."""

from __future__ import annotations

import math

import duckdb
import pytest

from laminar.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.01"


def clean(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_rows_agree(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    rel = con.sql(oracle_sql()[name])
    got = queries()[name](spark, SF)
    assert sorted(rel.columns) == sorted(got.columns)
    names = sorted(rel.columns)
    place = [rel.columns.index(c) for c in names]
    want = sorted((tuple(clean(r[k]) for k in place) for r in rel.fetchall()), key=str)
    assert sorted((tuple(clean(r[c]) for c in names) for r in got.collect()), key=str) == want
