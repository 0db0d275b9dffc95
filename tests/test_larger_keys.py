"""Queries against their SQL on tables whose keys lie beyond those of the given ones."""

from __future__ import annotations

import duckdb
import pytest

from laminar.plans.registry import ORACLE, QUERIES

from .test_queries import rows


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for f in folder.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, str(folder))
    rel = con.sql(ORACLE[name])
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", ["file_stats", "rule_violations", "validation_lines"])
def test_axis_documents_of_large_customers(spark, tmp_path, name):
    duckdb.sql(f"COPY (SELECT i AS o_orderkey, 20000 + i * 97 AS o_custkey FROM range(200) t(i)) TO '{tmp_path}/orders.parquet'")
    same_as_sql(spark, tmp_path, name)


def test_id_numbers_of_many_suppliers(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT i * 11 AS l_orderkey, i % 23 AS l_partkey, (i % 5 + 1) * 1000 + i % 7 AS l_suppkey FROM range(2000) t(i)) TO '{tmp_path}/lineitem.parquet'")
    same_as_sql(spark, tmp_path, "id_map_documents")
