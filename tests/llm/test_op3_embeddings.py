from __future__ import annotations

import numpy as np
import pytest

from laminar.llm import embedding_dedup
from laminar.llm.embedding_dedup import MultiIndex, near_duplicate_vectors, visit_order
from laminar.llm.queries import op3_embedding_dedup


def brute(rows, cosine=0.9):
    """id -> (links, component) by comparing all pairs."""
    good = {i: np.array(v, dtype=np.float64) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and np.any(np.array(v, dtype=float))}
    ids = sorted(good)
    u = np.stack([good[i] / np.linalg.norm(good[i]) for i in ids])
    link = u @ u.T >= cosine
    np.fill_diagonal(link, False)
    comp = list(range(len(ids)))
    for _ in range(len(ids)):
        new = [min([comp[k], *(comp[j] for j in np.flatnonzero(link[k]))]) for k in range(len(ids))]
        if new == comp:
            break
        comp = new
    out = {i: (int(link[k].sum()), ids[comp[k]]) for k, i in enumerate(ids)}
    return {i: out.get(i, (0, i)) for i, _ in rows}


def clouds(seed, groups=12, size=14, lone=300, noise=0.035, dim=64):
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(rng.standard_normal((groups, dim)))
    near = unit(np.repeat(base, size, 0) + noise * rng.standard_normal((groups * size, dim)))
    return np.concatenate([near, unit(rng.standard_normal((lone, dim)))])


def compare(got, want):
    found = sum(min(r["n_links"], want[r["vec_id"]][0]) for r in got)
    total = sum(w[0] for w in want.values())
    assert all(r["n_links"] <= want[r["vec_id"]][0] for r in got)
    assert found >= 0.98 * total
    same = np.mean([r["component_id"] == want[r["vec_id"]][1] for r in got])
    assert same > 0.99
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = op3_embedding_dedup(spark, sf).collect()
    assert sorted(r["vec_id"] for r in got) == sorted(i for i, _ in rows)
    compare(got, brute(rows))


@pytest.mark.parametrize("block", [1024, 16])
def test_planted_groups(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    x = clouds(3)
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)]
    rows += [(1000 + k, rows[0][1]) for k in range(5)] + [(2000 + k, [4 * v for v in rows[20][1]]) for k in range(3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    compare(near_duplicate_vectors(table).collect(), brute(rows))


def test_visit_order_is_nearest_first():
    rng = np.random.default_rng(2)
    d1, d2 = rng.random((20, 9)), rng.random((20, 7))
    for cells in (1, 5, 30, 63):
        got = visit_order(d1, d2, cells)
        total = (d1[:, :, None] + d2[:, None, :]).reshape(20, -1)
        want = np.sort(total, 1)[:, :cells]
        assert np.allclose(np.take_along_axis(total, got, 1), want)


def test_recall_of_partners_at_the_threshold():
    x = clouds(5, lone=2000)
    index = MultiIndex(x, 16, 0.9, 0.99)
    rng = np.random.default_rng(9)
    q = x[:400]
    away = rng.standard_normal(q.shape)
    away -= (away * q).sum(1, keepdims=True) * q
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    partner = 0.9 * q + np.sqrt(1 - 0.81) * away
    hit = [c in set(v) for c, v in zip(index.cell(partner), index.visit(q), strict=True)]
    assert np.mean(hit) > 0.95


def test_odd_rows(spark):
    one = [1.0] + [0.0] * 7
    rows = [(1, None), (2, []), (3, [0.0] * 8), (4, [1.0, None] + [0.0] * 6), (5, [float("nan")] + one[1:]), (6, [float("inf")] + one[1:]), (7, one), (8, one), (9, [2.0] + one[1:]), (10, [1.0, 2.0]), (11, [-1.0] + one[1:])]
    table = spark.createDataFrame([(i, v, "x", "y", 0) for i, v in rows] + [(None, one, "x", "y", 0), (7, one, "x", "y", 0)], "vec_id long, embedding array<double>, id string, rep string, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_duplicate_vectors(table).collect()}
    assert sorted(got) == list(range(1, 12))
    assert all(got[k] == (0, k, True) for k in (1, 2, 3, 4, 5, 6, 10, 11))
    assert got[7] == (2, 7, True) and got[8] == (2, 7, False) and got[9] == (2, 7, False)
    assert near_duplicate_vectors(table.limit(0)).count() == 0


def test_vectors_are_sent_by_bays(spark, monkeypatch):
    """Copies of a vector that are sent follow the number of bays, not of the shelves it visits; results are those of brute force."""
    seen = {}

    def kept(df, name):
        if name == "found":
            plan = df._jdf.queryExecution().optimizedPlan()
            while "FlatMapGroupsInPandas" not in plan.nodeName():
                plan = plan.children().head()
            seen["sent"] = df._jdf.ofRows(df._jdf.sparkSession(), plan.children().head()).count()
        return staged(df, name)

    staged = embedding_dedup.stage
    monkeypatch.setattr(embedding_dedup, "stage", kept)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 256)
    x = clouds(8, groups=40, lone=1440)
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)]
    compare(near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect(), brute([(i, np.float32(v).tolist()) for i, v in rows]))
    assert seen["sent"] <= 2 * 6 * len(x)  # six bays, each vector as a member and as a seeker


def test_bays_hold_like_numbers():
    words = np.random.default_rng(4).standard_normal((64, 8))
    held = np.full(64, 100.0)
    made = embedding_dedup.bays(words, held, 5)
    assert sorted(set(made)) == list(range(5)) and max(np.bincount(made)) <= 13
    held[7] = 5000.0
    assert max(np.bincount(embedding_dedup.bays(words, held, 5), weights=held)) <= 7600
