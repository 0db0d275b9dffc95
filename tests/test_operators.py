from __future__ import annotations

import json
import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from laminar.graph import connected_components
from laminar.operators import spiral, validate, voxels, windings
from laminar.session import ship
from laminar.sources import sinks, tables


def find(edges):
    parent: dict = {}

    def root(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in list(parent)}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=1, max_size=40))
def test_components_of_random_edges(spark, edges):
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == find([(a, b) for a, b in edges if a != b])


def test_components_of_a_long_chain_and_nothing(spark):
    chain = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r["component"] for r in connected_components(chain).collect()} == {0}
    assert connected_components(chain.limit(0)).count() == 0


CASES = {
    "valid": ('{"vc_pointcollections_json_version":"1","collections":{"0":{"name":"a","points":{"0":{"p":[1,2,3]},"1":{"p":[4,5.5,6],"creation_time":1}},"metadata":{},"color":[1,0,0]}}}', []),
    "umbilicus": ('{"control_points":[{"z":1,"y":2,"x":3},{"z":2,"y":2,"x":3},{"z":3,"y":2,"x":3}]}', []),
    "version_number": ('{"vc_pointcollections_json_version":1,"collections":{}}', ["version"]),
    "version_two": ('{"vc_pointcollections_json_version":"2","collections":{}}', ["version"]),
    "mixed": ('{"vc_pointcollections_json_version":"1","collections":{"0":{"name":"a","points":{"0":{"p":[1,2,3],"wind_a":1},"1":{"p":[1,2,3]}}}}}', ["mixed_wind"]),
    "short": ('{"vc_pointcollections_json_version":"1","collections":{"0":{"name":"a","points":{"0":{"p":[1,2]}}}}}', ["coordinates"]),
    "boolean": ('{"vc_pointcollections_json_version":"1","collections":{"0":{"name":"a","points":{"0":{"p":[true,true,true]}}}}}', ["coordinates"]),
    "x_out": ('{"vc_pointcollections_json_version":"1","collections":{"0":{"name":"a","points":{"0":{"p":[7593,2,3]}}}}}', ["bounds"]),
    "z_out": ('{"vc_pointcollections_json_version":"1","collections":{"0":{"name":"a","points":{"0":{"p":[1,2,23247]}}}}}', ["bounds"]),
    "one_point": ('{"control_points":[{"z":1,"y":2,"x":3}]}', ["too_few_points"]),
    "no_name": ('{"vc_pointcollections_json_version":"1","collections":{"0":{"points":{"0":{"p":[1,2,3]}}}}}', ["name"]),
    "unknown_key": ('{"vc_pointcollections_json_version":"1","collections":{"0":{"name":"a","points":{"0":{"p":[1,2,3]}},"extra":1}}}', ["unknown_key"]),
    "colour": ('{"vc_pointcollections_json_version":"1","collections":{"0":{"name":"a","points":{"0":{"p":[1,2,3]}},"color":[1,2]}}}', ["color"]),
    "metadata": ('{"vc_pointcollections_json_version":"1","collections":{"0":{"name":"a","points":{"0":{"p":[1,2,3]}},"metadata":[]}}}', ["metadata"]),
    "other": ('{"a":1}', ["unknown_kind"]),
    "broken": ('{"a":', ["unreadable"]),
}


def test_validator_cases(spark):
    docs = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "doc string, payload string")
    got: dict = {k: [] for k in CASES}
    for r in validate.violations(docs).collect():
        got[r["doc"]].append(r["rule"])
    assert {k: sorted(set(v)) for k, v in got.items()} == {k: v[1] for k, v in CASES.items()}
    stats = {r["doc"]: r for r in validate.file_stats(docs).collect()}
    assert stats["valid"]["ok"] and stats["valid"]["n_points"] == 2 and stats["unknown_key"]["ok"] and not stats["short"]["ok"]


def test_capped_merge_respects_cap_and_order(spark):
    ship(spark)
    sizes = spark.createDataFrame([(0, k, 10) for k in range(20)], "slab long, label long, n long")
    pairs = spark.createDataFrame([(0, k, k + 1, 1.0 / (k + 1)) for k in range(19)], "slab long, a long, b long, mean_depth double")
    got = {r["label"]: r["merged"] for r in voxels.capped_merge(pairs, sizes, 0.2).collect()}
    size: dict = {}
    for m in got.values():
        size[m] = size.get(m, 0) + 10
    assert max(size.values()) < 0.2 * 200 and got[1] == got[0] and len(got) == 20


def test_label_blocks_and_id_maps(spark, tmp_path):
    ship(spark)
    labels = np.zeros((3, 4, 5), np.int32)
    labels[1, 2, 3], labels[2, 0, 0] = 7, 9
    (tmp_path / "blocks" / "z224").mkdir(parents=True)
    np.savez_compressed(tmp_path / "blocks" / "z224" / "tile_y448_x0.npz", labels=labels, z0=224, y0=448, x0=0)
    got = sorted(map(tuple, tables.read_label_blocks(spark, str(tmp_path / "blocks")).collect()))
    assert got == [(224, 448, 0, 1, 2, 3, 7), (224, 448, 0, 2, 0, 0, 9)]
    (tmp_path / "map.json").write_text(json.dumps({"z224/y448_x0": {"7": 70, "9": 90}}))
    ids = tables.read_id_maps(spark, str(tmp_path / "map.json"))
    assert sorted(map(tuple, ids.select(*tables.tile_key(F.col("tile")), "local_id", "gid").collect())) == [(224, 448, 0, 7, 70), (224, 448, 0, 9, 90)]
    listed = {r["prefix"]: r["files"] for r in tables.list_files(spark, str(tmp_path)).collect()}
    assert listed == {"blocks": 1, "map.json": 1}


@pytest.mark.parametrize("codec", [None, "zlib"])
def test_zarr_chunks(spark, tmp_path, codec):
    ship(spark)
    full = np.random.default_rng(0).integers(0, 3, (5, 6, 7)).astype(np.uint8)
    meta = {"shape": [5, 6, 7], "chunks": [4, 4, 4], "dtype": "|u1", "compressor": codec and {"id": codec}, "zarr_format": 2}
    for i in range(2):
        for j in range(2):
            for k in range(2):
                block = np.zeros((4, 4, 4), np.uint8)
                part = full[4 * i : 4 * i + 4, 4 * j : 4 * j + 4, 4 * k : 4 * k + 4]
                block[: part.shape[0], : part.shape[1], : part.shape[2]] = part
                data = block.tobytes()
                (tmp_path / f"{i}.{j}.{k}").write_bytes(zlib.compress(data) if codec else data)
    chunks = tables.read_chunks(spark, str(tmp_path), meta)
    got = sorted(map(tuple, tables.read_box(chunks, (1, 2, 3), (5, 5, 7), (4, 4, 4)).collect()))
    want = sorted((z, y, x, int(full[z, y, x])) for z in range(1, 5) for y in range(2, 5) for x in range(3, 7) if full[z, y, x])
    assert got == want


def test_csv_readers(spark, tmp_path):
    (tmp_path / "n.csv").write_text("z,theta,pitch\n1,2,3.5\n1,x,2\n2,3,NaN\n4,5,6\n")
    assert sorted(map(tuple, tables.read_numbers(spark, str(tmp_path / "n.csv"), ["z", "theta", "pitch"]).collect())) == [(1, 2, 3.5), (4, 5, 6)]
    (tmp_path / "a.csv").write_text("gz,gy,gx\n2,4,6\n")
    (tmp_path / "b.csv").write_text("z,y,x\n1,2,3\n,1,1\n")
    for n in "ab":
        assert [tuple(r) for r in tables.read_sites(spark, str(tmp_path / f"{n}.csv")).collect()] == [(1, 2, 3)]


def test_axis_and_collection_documents(spark, tmp_path):
    (tmp_path / "u.json").write_text('{"control_points":[{"z":3,"y":1,"x":2},[1,5,6]]}')
    assert [tuple(r) for r in tables.read_axis(spark, str(tmp_path / "u.json")).collect()] == [(1, 5, 6), (3, 1, 2)]
    pts = spark.createDataFrame([(0, 'a"b', 0, 1, 2, 3, None), (0, 'a"b', 1, 4, 5, 6, None), (1, "c", 0, 7, 8, 9, 1.5)], "collection long, name string, point long, z long, y long, x long, wind_a double")
    doc = json.loads(sinks.collection_json(pts).first()["value"])
    assert doc["collections"]["0"]["name"] == 'a"b' and doc["collections"]["0"]["points"]["1"]["p"] == [6, 5, 4] and doc["collections"]["1"]["points"]["0"]["wind_a"] == 1.5
    sinks.write_text(sinks.collection_json(pts), str(tmp_path / "out"))
    docs = tables.read_collections(spark, str(tmp_path / "out"))
    assert validate.violations(docs.where("payload != ''")).count() == 0
    axis = sinks.axis_json(spark.createDataFrame([(2.0, 1.0, 1.0), (1.0, 3.0, 4.0)], "z double, y double, x double")).first()["value"]
    assert [p["z"] for p in json.loads(axis)["control_points"]] == [1.0, 2.0]


def test_png_and_csv_sinks(spark, tmp_path):
    px = sinks.colours(spark.createDataFrame([(0, 0, 1), (1, 2, 5), (1, 0, 0)], "y int, x int, gid long"))
    picture = sinks.png(px, 2, 3)
    at = picture.index(b"IDAT")
    raw = zlib.decompress(picture[at + 4 : at + 4 + int.from_bytes(picture[at - 4 : at], "big")])
    assert len(raw) == 2 * (1 + 9) and raw[1:4] != b"\0\0\0" and raw[11:14] == b"\0\0\0" and raw[17:20] != b"\0\0\0"
    for _ in range(2):
        sinks.append_csv(px, str(tmp_path / "c"), gzip=True)
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 6
    sinks.write_labels(px.withColumn("slab_z0", F.col("y")), str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).where("slab_z0 = 1").count() == 2


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    p = rng.random((200, 3)) * 12
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(p)], "id long, z double, y double, x double")
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    want = {(i, int(j)) for i in range(200) for j in np.argsort(d[i], kind="stable")[1:6] if d[i, j] < 2}
    assert {(r["src"], r["dst"]) for r in windings.knn_pairs(df, 2.0, 5).collect()} == want
