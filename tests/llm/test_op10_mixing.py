from __future__ import annotations

from collections import defaultdict

import re

from laminar.llm.mixing import mix_copies, mix_sources, source_targets
from laminar.llm.queries import op10_source_mixing

from .conftest import ODD


def brute_targets(sizes, weights=(5, 2, 1), most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = float(sum(sizes.values())), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free} if free else {}
        over = {s for s in free if share[s] > most * sizes[s] * (1 + 1e-12)}
        if not over:
            return {s: share.get(s, most * sizes[s]) for s in names}
        capped |= over


def _sizes(rows):
    return [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, s in rows]


def test_query(spark, corpus):
    rows = _sizes(corpus.select("doc_id", "text", "source").collect())
    by = defaultdict(int)
    for _, s, n in rows:
        by[s] += n
    want = brute_targets(by)
    got = op10_source_mixing(spark, "/root/testdata/sf0.01").collect()
    assert sorted((r["doc_id"], r["size"], r["source_size"]) for r in got) == sorted((d, n, by[s]) for d, s, n in rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) <= 1e-9 * want[r["source"]]
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in want:  # one open document a source is rounded by itself
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6
    again = op10_source_mixing(spark.newSession(), "/root/testdata/sf0.01").repartition(3).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_small_fan_makes_a_deep_tree(make_docs):
    docs = make_docs([(k, "w " * (k % 7 + 1), "a") for k in range(300)] + [(k, "w " * 3, "b") for k in range(300, 420)])
    got = mix_copies(docs, weights=(1, 1), fan=3).collect()
    total = sum(r["size"] for r in got)
    for s in ("a", "b"):
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - total / 2) <= 7


def test_expectation(make_docs):
    docs = make_docs([(k, "w " * (k % 5 + 1), "ab"[k % 2]) for k in range(200)])
    held, ratio = defaultdict(list), {}
    for seed in range(5):
        for r in mix_copies(docs, weights=(3, 1), seed=seed).collect():
            held[r["source"], r["size"]].append(r["copies"])
            ratio[r["source"]] = r["target"] / r["source_size"]
    for (s, _), copies in held.items():  # long and short documents alike
        assert abs(sum(copies) / len(copies) - ratio[s]) < 0.2


def test_targets_fill_up(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 1, "d": 0}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(rows).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-9 * max(1, want[s]) for s in want)
    assert abs(sum(got.values()) - 1016) < 1e-6


def test_odd_rows(make_docs):
    docs = make_docs([(*r, s) for r in ODD for s in ("x", None)])
    got = mix_copies(docs).collect()
    assert len(got) == 2 * len(ODD)
    assert all(r["taken"] == 0 and r["size"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    same = {(r["doc_id"], r["source"]): set() for r in got}
    for r in got:
        same[r["doc_id"], r["source"]].add(r["copies"])
    assert all(len(v) == 1 for v in same.values())
    mixed = mix_sources(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in got)
    assert mix_copies(docs.limit(0)).count() == 0 and mix_sources(docs.limit(0)).count() == 0
