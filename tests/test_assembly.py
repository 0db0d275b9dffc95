"""Assembly, growing components, components with offsets and spaced points against plain computations."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from laminar.component_table import ComponentTable
from laminar.graph import conflicts, connected_components, offset_components
from laminar.operators import assembly, windings


def plain_components(nodes, edges):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_tile_votes_of_bands_and_corners(spark):
    rng = random.Random(1)
    tile, stride = 8, 5
    cover = lambda c: [t for t in range(3) if t * stride <= c < t * stride + tile]
    rows = [(s, ty, tx, z, y, x, rng.randrange(4)) for s in (0, 20) for z in range(3) for y in range(18) for x in range(18) if rng.random() < 0.5 for ty in cover(y) for tx in cover(x)]
    at = {r[:6]: r[6] for r in rows}
    want = Counter()
    for (s, ty, tx, z, y, x), b in at.items():
        for side, before in (("left", (ty, tx - 1)), ("top", (ty - 1, tx))):
            a = at.get((s, *before, z, y, x), 0)
            if a and b:
                want[(s, ty, tx, side, a, b)] += 1
    labels = spark.createDataFrame(rows, "slab long, ty long, tx long, z long, y long, x long, label long")
    got = {tuple(r)[:6]: r["n"] for r in assembly.tile_band_votes(labels, tile, stride).collect()}
    assert got == dict(want)
    assert assembly.tile_band_votes(labels.limit(0), tile, stride).count() == 0


def test_slabs_that_do_not_meet_are_not_linked(spark):
    rows = [(s, 0, 0, z, y, 0, 1) for s in (0, 12, 30) for z in range(s, s + 16) for y in range(3)]
    labels = spark.createDataFrame(rows, "slab long, ty long, tx long, z long, y long, x long, label long")
    inst = labels.select("slab", "ty", "tx", "label").distinct().withColumn("gid", F.lit(1).cast("long"))
    got = assembly.slab_band_votes(labels, inst, 16, 4).collect()
    assert [tuple(r) for r in got] == [(12, 0, 0, 1, 1, 12)]


def test_node_ids_keep_their_order_and_refuse_large_numbers(spark):
    df = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 1, 0), (0, 1, 0, 0), (1, 0, 0, 0)], "s long, ty long, tx long, l long")
    ids = [r[0] for r in df.select(assembly.tile_node(*[F.col(c) for c in df.columns])).collect()]
    assert ids == sorted(ids) and len(set(ids)) == 4
    with pytest.raises(Exception, match="too large for a packed"):
        df.select(assembly.slab_node(F.col("s") + (1 << 30), F.col("l"))).collect()


def test_batches_one_by_one_equal_one_run(spark, tmp_path):
    rng = random.Random(7)
    nodes = [s * 100 + k for s in range(5) for k in range(40)]
    links = [(s * 100 + rng.randrange(40), (s + rng.randrange(2)) * 100 + rng.randrange(40)) for s in range(4) for _ in range(25)]
    part = lambda node: F.floor(node / 100)
    table = ComponentTable(spark, str(tmp_path / "c"), part)
    assert table.read().count() == 0
    for s in range(5):
        new = spark.createDataFrame([(n,) for n in nodes if n // 100 == s], "node long")
        some = [e for e in links if max(e) // 100 == s]
        table.add(new, spark.createDataFrame(some, "src long, dst long"))
        want = plain_components([n for n in nodes if n // 100 <= s], [e for e in links if max(e) // 100 <= s])
        assert {r["node"]: r["component"] for r in table.read().collect()} == want
    # another object goes on from what is stored; known nodes and links change nothing
    again = ComponentTable(spark, str(tmp_path / "c"), part)
    again.add(spark.createDataFrame([(1,)], "node long"), spark.createDataFrame(links[:3], "src long, dst long"))
    assert again.batches() == 6
    assert {r["node"]: r["component"] for r in again.read().collect()} == want


def test_a_batch_without_its_commit_does_not_count(spark, tmp_path):
    table = ComponentTable(spark, str(tmp_path / "c"))
    one = spark.createDataFrame([(1, 2)], "src long, dst long")
    none = one.select(F.col("src").alias("node")).limit(0)
    table.add(none, one)
    one.selectExpr("9L AS node", "9L AS entry", "0L AS part").write.partitionBy("part").parquet(str(tmp_path / "c" / "nodes" / "batch=2"))
    assert {tuple(r) for r in table.read().collect()} == {(1, 1), (2, 1)}
    table.add(none, spark.createDataFrame([(2, 3)], "src long, dst long"))
    assert {tuple(r) for r in table.read().collect()} == {(1, 1), (2, 1), (3, 1)}


def plain_offsets(edges):
    """Edges in order, passed over when their ends are joined already."""
    comp, off, bad = {}, {}, []
    for pos, a, b, d in sorted(edges):
        for n in (a, b):
            comp.setdefault(n, n)
            off.setdefault(n, 0)
        if comp[a] == comp[b]:
            if off[b] - off[a] != d:
                bad.append((pos, a, b, d))
            continue
        shift, old = off[a] + d - off[b], comp[b]
        for n in comp:
            if comp[n] == old:
                comp[n], off[n] = comp[a], off[n] + shift
    low = {}
    for n, c in comp.items():
        low[c] = min(low.get(c, n), n)
    return {n: (low[c], off[n] - off[low[c]]) for n, c in comp.items()}, bad


@pytest.mark.parametrize("seed, noise", [(1, 0.0), (2, 0.2), (3, 0.6)])
def test_offsets_follow_the_order_of_edges(spark, seed, noise):
    rng = random.Random(seed)
    level = {n: rng.randrange(50) for n in range(120)}
    edges = [(rng.randrange(60), a, b, level[b] - level[a] + (rng.randrange(1, 5) if rng.random() < noise else 0)) for a, b in ((rng.randrange(120), rng.randrange(120)) for _ in range(160)) if a != b]
    edges = list(dict.fromkeys(edges))
    df = spark.createDataFrame(edges, "pos long, src long, dst long, delta long")
    placed = offset_components(df)
    want, bad = plain_offsets(edges)
    assert {r["node"]: (r["component"], r["offset"]) for r in placed.collect()} == want
    got = conflicts(df, placed).where("conflict").collect()
    assert sorted((r["pos"], r["src"], r["dst"], r["delta"]) for r in got) == sorted(bad)


def test_offsets_of_a_long_chain_and_odd_edges(spark):
    n = 20_000
    chain = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(3).alias("delta"), (F.col("id") * 7919 % n).alias("pos"))
    out = offset_components(chain)
    assert out.where("component != 0 OR offset != 3 * node").count() == 0 and out.count() == n + 1
    odd = spark.createDataFrame([(1, 1, 5, 0), (None, 2, 1, 0), (3, 4, 1, 0), (3, 4, 1, 0), (4, 3, 1, 1)], "src long, dst long, delta long, pos long")
    assert {tuple(r) for r in offset_components(odd).collect()} == {(3, 3, 0), (4, 3, 1)}
    assert offset_components(odd.limit(0)).count() == 0


def breadth_first(edges):
    near = defaultdict(list)
    for a, b in edges:
        near[a].append((b, 1))
        near[b].append((a, -1))
    out = {}
    for start in near:
        if start in out:
            continue
        seen, wave = {start: 0}, [start]
        for node in wave:
            for other, d in near[node]:
                if other not in seen:
                    seen[other] = seen[node] + d
                    wave.append(other)
        low, name = min(seen.values()), min(seen)
        out.update({k: (name, v - low) for k, v in seen.items()})
    return out


def test_windings_equal_the_breadth_first_ones_and_late_contradictions_go(spark):
    rng = random.Random(4)
    level = {n: n // 6 for n in range(60)}
    good = [(a, b) for a in range(60) for b in range(60) if level[b] - level[a] == 1 and rng.random() < 0.3]
    rows = [(a, b, k) for k, (a, b) in enumerate(good)] + [(5, 4, 10_000), (20, 3, 10_001)]
    placed, checked = windings.relative_windings(spark.createDataFrame(rows, "inner long, outer long, pos long"))
    assert {r["node"]: (r["component"], r["winding"]) for r in placed.collect()} == breadth_first(good)
    assert {(r["inner"], r["outer"]) for r in checked.where("conflict").collect()} == {(5, 4), (20, 3)}


def greedy(rows, hashes, k, apart):
    out = set()
    for gid in {r[0] for r in rows}:
        cands = sorted({r[1:] for r in rows if r[0] == gid})
        rank = sorted(cands, key=lambda p: (hashes[(gid, *p)], p))
        chosen = []
        fits = lambda p: all(sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) >= apart * apart for q in chosen)  # noqa: B023, E731
        parts = min(k, len(cands))
        size, more = divmod(len(cands), parts)
        at = 0
        for c in range(parts):
            chunk = cands[at : at + size + (c < more)]
            at += len(chunk)
            for p in sorted(chunk, key=rank.index):
                if fits(p):
                    chosen.append(p)
                    break
        for p in rank:
            if len(chosen) < k and fits(p):
                chosen.append(p)
        out |= {(gid, *p) for p in chosen}
    return out


@pytest.mark.parametrize("k, batch", [(5, 2), (12, 1), (12, 16)])
def test_spaced_points_are_those_of_a_greedy_pass(spark, k, batch):
    rng = random.Random(k)
    rows = [(g, rng.randrange(3 + 12 * g), rng.randrange(4 + 5 * g), rng.randrange(9)) for g in range(5) for _ in range(20 + 90 * g)]
    rows += [(9, 1, 1, 1)] * 30 + [(10, 50, 0, x) for x in range(3)]
    df = spark.createDataFrame(rows, "gid long, z long, y long, x long")
    hashes = {tuple(r)[:4]: r["h"] for r in df.withColumn("h", F.xxhash64("gid", "z", "y", "x")).collect()}
    odd = df.union(spark.createDataFrame([(None, 1, 1, 1), (1, None, 1, 1)], df.schema))
    got = [tuple(r) for r in windings.spaced_points(odd, k, 5.0, batch).collect()]
    assert len(got) == len(set(got))
    assert set(got) == greedy(rows, hashes, k, 5.0)


def test_spaced_points_of_nothing(spark):
    assert windings.spaced_points(spark.createDataFrame([], "gid long, z long, y long, x long")).count() == 0


def test_components_ignore_order(spark):
    edges = [(k, k + 1) for k in range(0, 40, 2)] + [(3, 2)]
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == plain_components({n for e in edges for n in e}, edges)
