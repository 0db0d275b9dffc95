"""Operator 12 against a plain computation with exact sums."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from laminar.llm.queries import op12_embedding_whitening
from laminar.llm.whitening import Centre, whiten

SCHEMA = "vec_id long, embedding array<float>"


def plain(vectors: list[list[float]], components: int):
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(row, sums, strict=True)] for row in x])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return n, deviation, centred @ v / np.sqrt(e), e / np.trace(centred.T @ centred / n)


def compare(rows, vectors, ids, components):
    n, deviation, white, share = plain(vectors, components)
    by = {}
    for r in rows:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(rows) == len(ids) * components
    got = np.array([[by[i][k]["whitened"] for k in range(1, components + 1)] for i in ids])
    sign = np.sign((got * white).sum(0))
    assert np.abs(got * sign - white).max() < 1e-7
    for i, d in zip(ids, deviation, strict=True):
        r = by[i][1]
        assert (r["n"], r["deviation"]) == (n, d)
        assert 0 <= r["identity_error"] < 1e-9
    assert np.allclose([by[ids[0]][k]["explained"] for k in range(1, components + 1)], share, rtol=1e-9)


def test_given_table(spark):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    rows = op12_embedding_whitening(spark, sf).collect()
    compare(rows, [r["embedding"] for r in table], [r["vec_id"] for r in table], 8)


def test_repeats_weigh_by_their_count(spark):
    rng = np.random.default_rng(1)
    some = np.float32(rng.normal(size=(40, 3))).tolist()
    vectors = some + [some[0]] * 60 + [some[1]] * 3
    table = spark.createDataFrame(list(enumerate(vectors)), SCHEMA).repartition(5)
    compare(whiten(table).collect(), vectors, list(range(len(vectors))), 3)
    once = whiten(table, weights="one")
    assert once.count() == 3 * len(vectors)
    assert once.first()["n"] == 40 and once.first()["identity_error"] < 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0], [0.0, 0.0], [-3.0, 5.5], [4.0, -1.0], [4.0, -1.0]]
    rows = [(k, v) for k, v in enumerate(good)] + [(None, [2.0, 2.0]), (3, [7.0, 1.0]), (10, None), (11, [1.0, None]), (12, [nan, 1.0]), (13, [inf, 1.0]), (14, []), (15, [1.0]), (16, [1e30, 0.0])]
    table = spark.createDataFrame(rows, SCHEMA)
    for extra in ("x", "m", "w", "k", "n", "d", "component", "deviation"):
        table = table.withColumn(extra, F.lit("clash"))
    out = whiten(table)
    got = out.collect()
    assert len(got) == 7 * 2 and {r["n"] for r in got} == {7}
    assert sorted({(r["vec_id"] is None, r["vec_id"]) for r in got}, key=str) == sorted({(False, k) for k in range(5)} | {(True, None)}, key=str)
    assert whiten(table.limit(0)).count() == 0
    assert whiten(table.where("vec_id >= 10 AND vec_id < 15")).count() == 0
    with pytest.raises(ValueError):
        whiten(table, weights="two")


def test_no_variance_and_less_rank(spark):
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(3)], SCHEMA)
    for r in whiten(same).collect():
        assert (r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (3, 0, None, None, None)
    line = spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(5)], SCHEMA)
    got = whiten(line).collect()
    assert all(r["whitened"] is None for r in got if r["component"] == 2)
    assert all(r["identity_error"] < 1e-9 for r in got)
    assert whiten(line.limit(1)).count() == 2


def test_numbers_beyond_a_long():
    centre = Centre(1 << 40, [0, 0], 1 << 41)
    scaled = centre.scaled(np.array([[1 << 41, -(1 << 41)], [0, 1]]))
    assert scaled[0, 0] == 1 << 81
    assert centre.deviation(scaled) == [None, None]
    assert centre.centred(scaled)[0].tolist() == [float(1 << 41), -float(1 << 41)]
    small = Centre(1 << 20, [3, 5], 1 << 20)
    assert small.deviation(small.scaled(np.array([[2, 2]]))) == [((2 << 20) - 3) ** 2 + ((2 << 20) - 5) ** 2]
