"""Steps whose work must not grow faster than their input: what they hand on, and that the results stay those of brute force."""

from __future__ import annotations

import re
import time
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from laminar import graph
from laminar.component_table import ComponentTable
from laminar.operators import assembly, sweep, voxels, windings
from laminar.plans import assembly as plans
from laminar.plans.registry import QUERIES
from laminar.session import ship
from laminar.sources import sinks, tables
from laminar.storage import stage

from .conftest import SF


def test_runs_are_the_nodes_of_voxel_components(spark, monkeypatch):
    seen = []

    def counted(edges, *rest):
        seen.append(edges.count())
        return found(edges, *rest)

    found = voxels.connected_components
    monkeypatch.setattr(voxels, "connected_components", counted)
    mask = spark.createDataFrame([(0, 0, y, x) for y in (0, 1, 3) for x in range(20)] + [(0, 2, 3, 0), (0, 0, 1, 25), (1, 0, 0, 0)], "slab long, z long, y long, x long")
    rows = voxels.voxel_components(mask, 32, 32).collect()
    assert seen[0] <= 40  # 40 contacts of voxels along y; those along x stay inside runs
    groups = {}
    for r in rows:
        groups.setdefault(r["component"], set()).add((r["slab"], r["z"], r["y"], r["x"]))
    assert sorted(map(len, groups.values())) == [1, 1, 1, 20, 40]


def test_tiles_are_made_by_many_tasks(spark):
    assert QUERIES["tile_grid"](spark, SF).rdd.getNumPartitions() > 4


def test_axis_lookup_is_no_window_over_all_vertices(spark):
    axis = [(2.5, 10.0, 5.0), (2.75, 12.0, 5.5), (40.0, 30.0, 1.0), (90.0, 0.0, 8.0)]
    z = [0.5, 2.5, 2.6, 2.8, 17.25, 40.0, 40.5, 89.9, 90.0, 95.0]
    points = spark.createDataFrame([(0, v, 100.0, 50.0) for v in z], "w long, z double, y double, x double")
    made = sweep.winding_radii(points, spark.createDataFrame(axis, "z double, cy double, cx double"), spark.createDataFrame([(45.0,)], "z0 double"), 100.0, 1)
    assert "partition=[one" not in made._jdf.queryExecution().toString().lower() and "one#" not in made._jdf.queryExecution().toString()
    a = np.array(axis)
    want = np.hypot(100 - np.interp(z, a[:, 0], a[:, 1]), 50 - np.interp(z, a[:, 0], a[:, 2]))
    assert sorted(r["r"] for r in made.collect()) == pytest.approx(sorted(want))


def test_nearest_pairs_of_dense_points(spark, monkeypatch):
    seen = {}

    def kept(df, name):
        seen[name] = staged(df, name)
        return seen[name]

    staged = windings.stage
    monkeypatch.setattr(windings, "stage", kept)
    rng = np.random.default_rng(5)
    p = np.concatenate([np.repeat([[0.5, 0.5, 0.5]], 60, axis=0), rng.normal(0, 0.02, (900, 3)), rng.uniform(-2, 2, (200, 3))])
    pairs = windings.knn_pairs(spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "id long, z double, y double, x double"), 0.8, 9)
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    want = {(i, int(j)) for i in range(len(p)) for j in sorted((j for j in np.flatnonzero(d[i] < 0.8) if j != i), key=lambda j: (d[i, j], j))[:9]}
    assert {(r["src"], r["dst"]) for r in pairs.collect()} == want
    assert seen["knnasks"].where("level >= 2").count() >= 900  # dense points look in cells of a quarter of the reach or less


def test_small_label_blocks_share_frames(spark, tmp_path, monkeypatch):
    rows = {(12 * s, 18 * t, 0, z, (z + t) % 5, z * s % 4, 1 + s + t) for s in range(3) for t in range(4) for z in range(6)}
    voxels_ = ship(spark).createDataFrame(sorted(rows), tables.LABEL_VOXEL)
    monkeypatch.setitem(tables.__dict__, "FRAME", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # tiles go on from batch to batch
    try:
        assert sinks.write_label_blocks(voxels_, str(tmp_path / "blocks"), (6, 5, 4)) == 12
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {tuple(r) for r in tables.read_label_blocks(spark, str(tmp_path / "blocks")).collect()} == rows
    blocks = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "blocks")).selectExpr("0L slab_z0", "0L tile_y0", "0L tile_x0", "content").toPandas()
    made = list(tables._block_voxels(iter([blocks])))
    assert sum(map(len, made)) == 72 and len(made) == 2  # a frame for every 50 voxels or more, not one a plane
    assert sinks.write_label_blocks(voxels_.limit(0), str(tmp_path / "none"), (6, 5, 4)) == 0


def test_offsets_start_from_the_trees_of_each_task(spark, monkeypatch):
    seen = {}

    def kept(df, name):
        out = staged(df, name)
        seen.setdefault(name, out.count())
        return out

    staged = graph.stage
    monkeypatch.setattr(graph, "stage", kept)
    level = {n: n * 7919 % 101 for n in range(600)}
    edges = [(a, b, level[b] - level[a] + (late and 1), late * 10**6 + a) for n in range(600) for a, b, late in ((n, n // 60 * 60 + n * 17 % 60, 0), (n, n // 60 * 60 + n * n % 60, 0), (n // 60 * 60, n, 0), (n, n // 60 * 60 + 1, 1))]
    placed = graph.offset_components(spark.createDataFrame(edges, "src long, dst long, delta long, pos long").coalesce(1)).collect()
    assert seen["offsetedges"] == 590  # ten trees of 60 nodes; all 1,700 pairs and more before
    assert {(r["node"], r["component"], r["offset"]) for r in placed} == {(n, n // 60 * 60, level[n] - level[n // 60 * 60]) for n in level}


def test_trees_of_a_task_keep_odd_edges(monkeypatch):
    monkeypatch.setattr(graph, "FOREST", 4)
    e = pd.DataFrame({"s": [1, 2, 3, 3, 4, 5, 1], "t": [2, 3, 1, 2, 5, 4, 4], "d": [1, 1, 1, None, 2, 2, 0], "o": [1, 2, 3, 0, 9, 8, None]}, dtype="Int64")
    got = pd.concat(graph._first_trees(iter([e[:3], e[3:]])))
    assert {tuple(None if pd.isna(v) else int(v) for v in r) for r in got.itertuples(index=False)} == {(1, 2, 1, 1), (2, 3, 1, 2), (3, 2, None, 0), (5, 4, 2, 8), (1, 4, 0, None)}


def test_voxels_of_slab_bands_are_shuffled_once(spark):
    labels = plans.labels(spark, SF)
    ids = spark.createDataFrame([(12, 0, 0, 1, 1)], "slab long, ty long, tx long, label long, gid long")
    plan = assembly.slab_band_votes(labels, ids, plans.DEPTH, plans.OVERLAP)._jdf.queryExecution().executedPlan().toString()
    moved = [keys for keys in re.findall(r"hashpartitioning\(([^)]*)\)", plan)]
    assert sum("z#" in keys for keys in moved) == 1  # labels met their ids by tile and label first, then each other by voxel, before
    assert not any("label#" in keys for keys in moved if "z#" in keys) and all("x#" not in keys.replace("tx#", "") for keys in moved)


def test_components_are_stored_in_one_file_a_part(spark, tmp_path):
    table = ComponentTable(spark, str(tmp_path / "c"), lambda node: F.floor(node / 100))
    table.add(spark.range(0, 500, 1, 8).withColumnRenamed("id", "node"), spark.createDataFrame([(1, 450), (2, 3)], "src long, dst long"))
    assert sorted(p.parent.name for p in (tmp_path / "c" / "nodes").rglob("*.parquet")) == [f"part={k}" for k in range(5)]


def test_slabs_share_the_parts_of_the_component_table(spark, monkeypatch):
    class Seen(ComponentTable):
        def __init__(self, spark_, path, part):
            super().__init__(spark_, path, part)
            made.append(self)

    made = []
    monkeypatch.setattr(plans, "ComponentTable", Seen)
    monkeypatch.setattr(plans, "PARTS", 2)
    QUERIES["whole_instances"](spark, SF)
    assert made[0]._nodes(2).select("part").distinct().count() <= 3  # ten slabs, a part each before


def test_spaced_points_stage_no_more_than_points(spark, monkeypatch):
    seen = []

    def kept(df, name):
        seen.append((name, df.columns, df.count()))
        return staged(df, name)

    staged = windings.stage
    monkeypatch.setattr(windings, "stage", kept)
    points = spark.range(2000).selectExpr("id % 2 AS gid", "id AS z", "id * 37 % 1000 AS y", "id * 91 % 1000 AS x")
    assert windings.spaced_points(points, 20).groupBy("gid").count().where("count = 20").count() == 2
    assert {n: c for n, _, c in seen}["spacedleft"] == 0  # both are full after their chunks; nearly 2,000 points before
    assert all("o" not in c and "cz" not in c for n, c, _ in seen if n in ("chunks", "chunkopen", "spacedleft"))


def test_shuffle_files_go_with_the_write_that_made_them(spark, tmp_path):
    """Shuffle files of a staged write are removed at its end; they stayed until the driver's garbage was collected before."""
    held = lambda: sum(f.stat().st_size for f in Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]).rglob("shuffle_*") if f.exists())
    rows = spark.range(0, 200_000, 1, 4).select(F.xxhash64("id").alias("k"), "id")
    before = held()
    made = stage(rows.groupBy("k").agg(F.max("id").alias("id")), "shuffled")
    assert made.count() == 200_000
    for _ in range(50):  # they are removed in the background
        if held() - before < 1_000_000:
            break
        time.sleep(0.1)
    assert held() - before < 1_000_000  # 2 MB and more before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
