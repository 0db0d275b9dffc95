from __future__ import annotations

import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from laminar.graph import connected_components
from laminar.llm.pigeonhole import hamming_links, hamming_pairs, spanning_forest
from laminar.llm.queries import op7_simhash_dedup
from laminar.llm.simhash_dedup import drop_near_duplicates, simhash_groups

from .conftest import ODD


def brute_fp(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps, bits=3):
    """fp -> component label, by comparing all pairs."""
    fps = sorted(set(fps))
    label = {f: f for f in fps}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f

    a = np.array(fps, dtype=np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= bits):
            x, y = root(f), root(fps[i + 1 + j])
            label[max(x, y)] = min(x, y)
    return {f: root(f) for f in fps}


def test_query_against_brute_force(spark, corpus):
    rows = corpus.select("doc_id", "text").collect()
    fp = {r[0]: brute_fp(r[1]) for r in rows}
    comp = brute_groups(fp.values())
    low = {}
    for d, f in fp.items():
        low[comp[f]] = min(low.get(comp[f], d), d)
    got = op7_simhash_dedup(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["fingerprint"] == f"{fp[r['doc_id']]:016x}"
        assert r["component_id"] == low[comp[fp[r["doc_id"]]]]


def _signed(values):
    return [v - (1 << 64) if v >= 1 << 63 else v for v in values]


def _clouds(seed=1):
    rng = np.random.default_rng(seed)
    out = {0}
    for _ in range(6):
        base = int(rng.integers(0, 2**63)) * 2 + 1
        for _ in range(60):
            v = base
            for b in rng.choice(64, int(rng.integers(0, 6)), replace=False):
                v ^= 1 << int(b)
            out.add(v)
    return sorted(out)


def test_crowded_blocks_lose_no_link(spark):
    values = _clouds()
    fps = spark.createDataFrame([(v,) for v in _signed(values)], "fp long")
    want = brute_groups(values)
    for crowd in (2, 64, 100000):
        comps = {r["node"]: r["component"] for r in connected_components(hamming_links(fps, 3, crowd)).collect()}
        groups, expected = {}, {}
        for v, s in zip(values, _signed(values), strict=True):
            groups.setdefault(comps.get(s, s), set()).add(v)
            expected.setdefault(want[v], set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_all_pairs_with_native_functions(spark):
    values = _clouds(5)
    signed = _signed(values)
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if (a ^ b).bit_count() <= 3 or ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    for crowd in (2, 100000):
        got = [(r[0], r[1]) for r in hamming_pairs(fps, 3, crowd).collect()]
        assert len(got) == len(set(got)) and set(got) == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 1023), unique=True, min_size=1, max_size=60))
def test_spanning_forest(values):
    edges = spanning_forest(np.array(values), 3)
    assert len(edges) < len(values)
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    want = brute_groups(values)
    label = {v: v for v in values}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    for a, b in edges:
        x, y = root(a), root(b)
        label[max(x, y)] = min(x, y)
    assert len({root(v) for v in values}) == len(set(want.values()))


def test_odd_rows(make_docs):
    docs = make_docs(ODD)
    got = simhash_groups(docs).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert {by[k][0]["fp"] for k in (1, 2, 3)} == {0} and {by[k][0]["component_id"] for k in (1, 2, 3)} == {1}
    assert len(by[4]) == 2 and by[5][0]["component_id"] == 4 and by[None][0]["component_id"] is None
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted(kept.select("doc_id").rdd.map(lambda r: -1 if r[0] is None else r[0]).collect())
    assert ids == [-1, 1, 4, 6, 7]
    assert simhash_groups(docs.where(F.lit(False))).count() == 0
    assert drop_near_duplicates(docs.where(F.lit(False))).count() == 0
