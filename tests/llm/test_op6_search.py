from __future__ import annotations

import numpy as np

from laminar.llm.mips_search import AnisotropicCoder, pack_nibbles, scan, search
from laminar.llm.queries import op6_inner_product_search


def brute(rows, queries, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for q in queries:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def compare(got, want, recall=0.98):
    by: dict = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert by.keys() == {q for q, w in want.items() if w}
    hit = total = 0
    for q, rows in by.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(want[q]) + 1))
        keys = [(-round(r["score"], 12), r["vec_id"]) for r in rows]
        assert keys == sorted(keys)
        near = {i for i, _ in want[q]}
        hit += len(near & {r["vec_id"] for r in rows})
        total += len(near)
        exact = dict(want[q])
        assert all(abs(exact[r["vec_id"]] - r["score"]) < 1e-9 for r in rows if r["vec_id"] in exact)
    assert hit >= recall * total


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    compare(op6_inner_product_search(spark, sf).collect(), brute(rows, [i for i, _ in rows if i % 20 == 0]), 0.999)


def test_copies_norms_and_near_copies(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 24)) * rng.choice([0.2, 1, 3], (900, 1))
    x[300:600] = x[0] + 1e-4 * rng.standard_normal((300, 24))
    x[600:700] = x[1]
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    compare(search(table, table.where("vec_id % 20 = 0")).collect(), brute(rows, range(0, 900, 20)), 0.99)


def test_odd_rows_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [0.5, 0.0]), (7, [1.0, 2.0, 3.0]), (20, [-1.0, 0.0]), (40, None), (0, [1.0, 0.0])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows] + [(None, [1.0, 1.0], "x", 1)], "vec_id long, embedding array<double>, rep string, shard int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in search(table, table.where("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 6, 0.5), (0, 3, 20, -1.0), (20, 1, 1, -0.5), (20, 2, 6, -0.5), (20, 3, 0, -1.0)]
    assert search(table.limit(0), table).count() == 0


def test_quantiser_weighs_the_parallel_error():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 16))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    plain, aware = AnisotropicCoder(x, parallel=1.0), AnisotropicCoder(x, parallel=6.0)
    along = [np.mean(((x - c.decode(c.encode(x))) * unit).sum(1) ** 2) for c in (plain, aware)]
    assert along[1] < 0.7 * along[0]


def test_table_scan_equals_decoding():
    rng = np.random.default_rng(7)
    x, q = rng.standard_normal((500, 10)), rng.standard_normal((3, 10))
    coder = AnisotropicCoder(x, width=2)
    codes = coder.encode(x)
    tables = coder.tables(q)
    for r in range(3):
        assert np.allclose(scan(tables[r], pack_nibbles(codes)), coder.decode(codes) @ q[r], atol=1e-4)
