from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from laminar.llm.packing import CAPACITIES, bin_cost, pack, pack_documents
from laminar.llm.queries import op2_best_fit_packing

from .conftest import ODD


def _price(capacity, n, waiting, capacities):
    """Cost per word of a bin opened for ``n`` and filled with the largest waiting pieces (sorted downwards) that fit."""
    full = n
    for m in waiting:
        if full + m <= capacity:
            full += m
    return bin_cost(min(c for c in capacities if c >= full)) / full


def _cost(bins, sizes):
    return sum(bin_cost(int(c)) for c in sizes)


def test_several_sizes_beat_any_single_one():
    """Pieces that fill different sizes: several are opened, at less cost than with any one size alone."""
    rng = np.random.default_rng(4)
    lengths = np.concatenate([np.full(60, 1000), np.full(40, 500), np.full(30, 250), np.full(5, 1900), rng.integers(30, 250, 50)]).astype(np.int64)
    bins, sizes = pack(lengths)
    assert len(set(sizes.tolist())) > 1
    used = np.bincount(bins, weights=lengths)
    for one in (c for c in CAPACITIES if c >= lengths.max()):
        alone, _ = pack(lengths, (one,))
        assert _cost(bins, sizes) < bin_cost(one) * len(set(alone.tolist()))
    assert (used <= sizes).all()


def slow_pack(lengths, capacities):
    """Best fit by looking at every open bin."""
    order = sorted(range(len(lengths)), key=lambda k: (-lengths[k], k))
    bins, room, at = [], [], [0] * len(lengths)
    for k in order:
        n = lengths[k]
        open_ = [(room[b], b) for b in range(len(bins)) if room[b] >= n]
        if open_:
            tight = min(r for r, _ in open_)
            b = [b for r, b in open_ if r == tight]
            b = b[-1] if len(b) == 1 else None
        else:
            c = min((c for c in capacities if c >= n), key=lambda c: (_price(c, n, [lengths[j] for j in order[order.index(k) + 1 :]], capacities), c))
            bins.append(0)
            room.append(c)
            b = len(bins) - 1
        if b is None:
            return None  # several equally tight bins: any may be taken
        bins[b] += n
        room[b] -= n
        at[k] = b
    return at, [min(c for c in capacities if c >= u) for u in bins]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=40))
def test_best_fit(lengths):
    capacities = (4, 8, 16)
    bins, sizes = pack(np.array(lengths, dtype=np.int64), capacities)
    used = defaultdict(int)
    for n, b in zip(lengths, bins, strict=True):
        used[b] += n
    for b, u in used.items():
        assert u <= sizes[b] and all(c < u for c in capacities if c < sizes[b])
    slow = slow_pack(lengths, capacities)
    if slow is not None:
        assert list(bins) == slow[0] and list(sizes) == slow[1]


def test_query_keeps_every_word(spark, corpus):
    got = op2_best_fit_packing(spark, "/root/testdata/sf0.01").collect()
    words = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in corpus.select("doc_id", "text").collect()}
    parts, bins = defaultdict(list), defaultdict(list)
    for r in got:
        parts[r["doc_id"]].append((r["start"], r["length"]))
        bins[r["bin_id"]].append(r)
    assert parts.keys() == words.keys()
    for d, p in parts.items():
        at = 0
        for start, n in sorted(p):
            assert start == at
            at += n
        assert at == words[d]
    for rows in bins.values():
        assert sum(r["length"] for r in rows) == rows[0]["used"] <= rows[0]["capacity"]
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        assert all(c < rows[0]["used"] for c in CAPACITIES if c < rows[0]["capacity"])
    filled = sum(r["length"] for r in got) / sum(v[0]["capacity"] for v in bins.values())
    assert filled > 0.97


def test_shards_and_odd_rows(make_docs):
    docs = make_docs(ODD)
    got = pack_documents(docs, shard_pieces=4).collect()
    assert sum(1 for r in got if r["bin_id"] is None) == 3
    assert sum(r["length"] for r in got if r["doc_id"] == 6) == 30000
    assert sorted(r["repeat"] for r in got if r["doc_id"] == 4) == [0, 1]
    again = pack_documents(docs.repartition(5), shard_pieces=4).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert pack_documents(docs.limit(0)).count() == 0
