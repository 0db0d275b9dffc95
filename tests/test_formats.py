"""Tracks, budgeted streams, file times, reports and components against plain computations."""

from __future__ import annotations

import json
import math
import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from laminar.functions.columns import dot, norm
from laminar.operators import axis, spiral, stitch, validate, voxels
from laminar.plans import adapters as A
from laminar.plans.registry import QUERIES
from laminar.session import ship
from laminar.sources import tables
from laminar.streaming import budget

from .conftest import SF


def plain_tracks(runs, bins, gate, skips, least):
    """Advance per (instance, slice, direction), by arrays of angle and radius."""
    groups = defaultdict(lambda: defaultdict(set))
    for gid, z, t, r in runs:
        groups[(gid, z)][t].add(r)
    flat = defaultdict(list)
    for gid, z, t, _ in runs:
        flat[(gid, z)].append(t)
    out = {}
    for key, by in groups.items():
        angle = np.array(flat[key]) * 2 * np.pi / bins
        sin, cos = np.sin(angle).mean(), np.cos(angle).mean()
        start = min(flat[key]) if math.hypot(sin, cos) < 1e-6 else round(math.atan2(sin, cos) * bins / (2 * np.pi)) % bins
        for direction in (1, -1):
            for seed in sorted(by.get(start, ())):
                r, missed, ts, rs = seed, 0, [0], [seed]
                for step in range(1, 2 * bins + 1):
                    near = sorted(by.get((start + direction * step) % bins, ()), key=lambda x: (abs(x - r), x))  # noqa: B023
                    if not near or abs(near[0] - r) > gate:
                        missed += 1
                        if missed > skips:
                            break
                        continue
                    r, missed = near[0], 0
                    ts.append(step)
                    rs.append(r)
                ts, rs = np.array(ts), np.array(rs)
                if ts[-1] < 1.03 * bins or (ts > bins).sum() < least:
                    continue
                late = ts > bins
                out[(*key, direction)] = (int(late.sum()), float(np.median(rs[late] - np.interp(ts[late] - bins, ts, rs)) * direction))
                break
    return out


def test_tracks_are_those_of_a_plain_tracker(spark):
    ship(spark)
    rng = random.Random(5)
    bins, runs = 36, []
    for gid in range(8):
        pitch, drop = rng.choice([0.0, 5.0, -5.0, 8.0]), rng.choice([0.0, 0.1, 0.3])
        for turn in range(4):
            for t in range(bins):
                if rng.random() >= drop:
                    runs.append((gid, gid % 2, t, round(30.0 + pitch * (turn + t / bins) + rng.random(), 3)))
    df = spark.createDataFrame(runs, "gid long, z long, theta long, r double")
    found = spiral.turn_advance(spiral.track(df, bins, gate=3.0, skips=4, least=5), bins)
    got = {(r["gid"], r["z"], r["direction"]): (r["n"], r["advance"]) for r in found.collect()}
    want = plain_tracks(runs, bins, 3.0, 4, 5)
    assert got.keys() == want.keys() and len(want) > 5
    for k, (n, advance) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(advance)
    assert spiral.track(df.limit(0), bins).count() == 0


def test_query_of_tracks(spark):
    from laminar.plans.further import _spiral_runs

    runs = [tuple(r) for r in _spiral_runs(spark, SF).select("gid", "z", "theta", "r").collect()]
    want = plain_tracks(runs, 60, 6.0, 15, 10)
    got = {(r["gid"], r["z"], r["direction"]): (r["n"], r["advance"]) for r in QUERIES["turn_advance"](spark, SF).collect()}
    assert {k: (n, pytest.approx(a)) for k, (n, a) in want.items()} == got
    sense = QUERIES["spiral_sense"](spark, SF).first()
    assert sense["spirals"] + sense["loops"] == len(want) and sense["sense"] == "CW"


def test_stopped_and_resumed_equals_unbroken(spark, tmp_path):
    for k in range(5):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    figures = lambda batch: batch.agg(F.sum("id").alias("s"), F.count("*").alias("n"))
    open_ = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    runs = 0
    while True:
        runs += 1
        if budget.run_within(open_(), figures, str(tmp_path / "a"), str(tmp_path / "ca"), 0.0):
            break
        assert not budget.is_complete(spark, str(tmp_path / "a"))
        assert runs < 10
    assert runs >= 3
    assert budget.run_within(open_(), figures, str(tmp_path / "b"), str(tmp_path / "cb"), 1e9)
    one, two = (sorted(map(tuple, budget.results(spark, str(tmp_path / p), "s long, n long").collect())) for p in "ab")
    assert one == two and sum(n for _, n in one) == 50
    manifest = spark.read.schema(budget.MANIFEST).parquet(str(tmp_path / "a" / "manifest")).collect()
    assert len(manifest) == runs and sum(r["complete"] for r in manifest) == 1
    assert sum(r["batches"] for r in manifest) == 5


def test_errors_of_a_batch_are_not_taken_for_the_end_of_time(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="nothere"):
        budget.run_within(stream, lambda b: b.select("nothere"), str(tmp_path / "o"), str(tmp_path / "c"), 1e9)
    assert not (tmp_path / "o" / "manifest").exists()


def test_file_times_in_utc(spark, tmp_path):
    for name, seconds in (("a.json", 86_400 * 365), ("b.json", 1_700_000_000)):
        (tmp_path / name).write_text("x" * len(name))
        os.utime(tmp_path / name, (seconds, seconds))
    (tmp_path / "c.json").write_text("")
    os.utime(tmp_path / "c.json", (0, 1))
    files = tables.file_times(spark, str(tmp_path))
    try:
        for zone in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = {r["name"]: r["modified_utc"] for r in files.collect()}
            assert got == {"a.json": "1971-01-01 00:00:00 UTC", "b.json": "2023-11-14 22:13:20 UTC"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    expected = spark.createDataFrame([("a.json", False), ("c.json", False), ("d.json", True), ("e.json", False)], "name string, optional boolean")
    out = {r["name"]: (r["status"], r["modified_utc"]) for r in validate.dated_manifest(expected, files).collect()}
    assert out["a.json"] == ("copied", "1971-01-01 00:00:00 UTC") and out["b.json"][0] == "skipped"
    assert [out[k] for k in ("c.json", "d.json", "e.json")] == [("missing", None), ("placeholder", None), ("missing", None)]


def test_report_and_exit_code(spark):
    good = {"vc_pointcollections_json_version": "1", "collections": {"0": {"name": "n", "points": {"0": {"p": [1, 2, 3]}}, "metadata": {}}}}
    docs = spark.createDataFrame([(1, json.dumps(good)), (2, "{broken")], "doc long, payload string")
    lines, code = validate.report(docs)
    rows = {r["doc"]: json.loads(r["value"]) for r in lines.collect()}
    assert code == 1 and rows[1]["ok"] and rows[1]["violations"] == []
    assert not rows[2]["ok"] and rows[2]["violations"][0]["rule"] == "unreadable"
    assert validate.report(docs.where("doc = 1"))[1] == 0


def face_components(cells):
    left, out = set(cells), []
    while left:
        wave, part = [left.pop()], 0
        while wave:
            z, y, x = wave.pop()
            part += 1
            for d in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)):
                q = (z + d[0], y + d[1], x + d[2])
                if q in left:
                    left.remove(q)
                    wave.append(q)
        out.append(part)
    return sorted(out)


def by_slab(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["slab"]].append((r["z"], r["y"], r["x"]))
    return out


def test_component_sizes_cleaning_and_rest(spark):
    v = A.voxels(spark, SF)
    want = defaultdict(int)
    for cells in by_slab(v.where("v > 0")).values():
        for n in face_components(cells):
            want[n] += 1
    assert {r["n"]: r["components"] for r in QUERIES["voxel_component_sizes"](spark, SF).collect()} == dict(want)
    gated = by_slab(v.where("pred > 0 AND v > 0"))
    for r in QUERIES["cleaning_components"](spark, SF).collect():
        sizes = face_components(gated[r["slab"]])
        assert (r["components"], r["kept"], r["cleaned"]) == (len(sizes), sum(n >= 30 for n in sizes), sum(n for n in sizes if n >= 30))
    lab = A.labelled(spark, SF)
    seeds = lab.where("depth >= 48 AND label % 7 != 3").select("slab", "label").distinct()
    rest = defaultdict(int)
    for slab, cells in by_slab(lab.join(seeds, ["slab", "label"], "left_anti")).items():
        for n in face_components(cells):
            rest[(slab, n)] += 1
    assert {(r["slab"], r["n"]): r["components"] for r in QUERIES["rest_components"](spark, SF).collect()} == dict(rest)


def test_sparse_cleaning(spark):
    rng = random.Random(1)
    rows = [(s, z, y, x, int(rng.random() < 0.35), int(rng.random() < 0.9)) for s in (0, 3) for z in range(5) for y in range(8) for x in range(8)]
    df = spark.createDataFrame(rows, "slab long, z long, y long, x long, pred long, ct long")
    got = {r["slab"]: r for r in voxels.cleaning_report(df, 8, 8, 4).collect()}
    for s in (0, 3):
        sizes = face_components([r[1:4] for r in rows if r[0] == s and r[4] and r[5]])
        assert (got[s]["components"], got[s]["kept"], got[s]["cleaned"]) == (len(sizes), sum(n >= 4 for n in sizes), sum(n for n in sizes if n >= 4))
        assert len(sizes) > 5


def test_centroids_fall_back(spark):
    mask = spark.createDataFrame([(1, 0, 2, 4, True), (1, 0, 4, 4, True), (1, 0, 90, 90, False), (1, 1, 5, 5, False)], "slab long, z long, y long, x long, own boolean")
    slices = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "slab long, z long")
    got = {r["z"]: (r["cy"], r["cx"], r["n"]) for r in axis.owned_centroids(mask, slices, 50.0, 60.0).collect()}
    assert got == {0: (3.0, 4.0, 2), 1: (50.0, 60.0, 0), 2: (50.0, 60.0, 0)}
    p = spark.createDataFrame([(1, float(k), 0.0) for k in range(11)] + [(2, 1.0, 1.0)], "g long, y double, x double")
    out = {r["g"]: (r["cy"], r["cx"], r["n"], r["n_kept"]) for r in axis.trimmed_centroids(p, ["g"], 0.2, 3, 9.0, 9.0).collect()}
    assert out == {1: (5.0, 0.0, 11, 7), 2: (9.0, 9.0, 1, 1)}


def test_policies_without_a_gap(spark):
    some = spark.createDataFrame([(1,), (2,), (2,)], "slab long")
    assert {r["policy"]: (r["slabs"], r["missing"], r["outcome"]) for r in stitch.slab_policies(some, some).collect()} == {p: (2, 0, "ok") for p in ("fail", "stop", "warn")}


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0]), ([1.0], [1.0, 2.0]), (None, [1.0]), ([], [])], "a array<double>, b array<double>")
    assert [tuple(r) for r in df.select(dot(F.col("a"), F.col("b")), norm(F.col("a"))).collect()] == [(11.0, 5.0), (None, 1.0), (None, None), (0.0, 0.0)]
