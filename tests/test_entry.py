from __future__ import annotations

import __spark_entry__ as entry


def test_contract(spark):
    made, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(made) and len(made) > 100
    df = entry.entry(spark)
    assert df.count() > 0 and "pitch_um" in df.columns


def test_plans_push_filters_and_prune_columns(spark):
    from laminar.plans.registry import QUERIES

    plan = QUERIES["label_sizes"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_partkey:bigint>" in plan
    plan = QUERIES["knn_contacts"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
