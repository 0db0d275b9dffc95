"""Data sources: arrays in chunks and meshes, written, read back, and read in part."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from laminar.sources.files import Folder
from laminar.sources.mesh_source import mesh_report, read_meshes, read_tiff, tiff, write_meshes
from laminar.sources.zarr_source import Layout, ZarrReader, read_zarr, write_zarr

SHAPE, CHUNKS = (10, 20, 30), (4, 8, 16)


@pytest.fixture()
def voxels(spark):
    rng = random.Random(2)
    at = {(rng.randrange(10), rng.randrange(20), rng.randrange(30)): float(rng.randrange(1, 9)) for _ in range(900)}
    return at, spark.createDataFrame([(*k, v) for k, v in at.items()], "z long, y long, x long, v double").repartition(5)


@pytest.mark.parametrize("codec", ["zlib", "gzip", "none"])
def test_an_array_reads_back(spark, tmp_path, voxels, codec):
    at, df = voxels
    write_zarr(df, str(tmp_path / "a"), SHAPE, CHUNKS, codec=codec)
    assert {tuple(r)[:3]: r["v"] for r in read_zarr(spark, str(tmp_path / "a")).collect()} == at
    meta = json.loads((tmp_path / "a" / ".zarray").read_text())
    assert (meta["shape"], meta["chunks"], meta["zarr_format"]) == (list(SHAPE), list(CHUNKS), 2)
    assert not (tmp_path / "a" / "_pending").exists()
    with pytest.raises(Exception, match="FileExists"):
        write_zarr(df, str(tmp_path / "a"), SHAPE, CHUNKS)
    assert not (tmp_path / "a" / "_pending").exists() or not list((tmp_path / "a" / "_pending").iterdir())


def test_a_box_opens_its_chunks_only(spark, tmp_path, voxels):
    at, df = voxels
    write_zarr(df, str(tmp_path / "a"), SHAPE, CHUNKS)
    inside = {k: v for k, v in at.items() if 4 <= k[0] < 8 and k[1] < 8 and 16 <= k[2]}
    for f in (tmp_path / "a").iterdir():  # all other chunks are spoilt
        if f.name not in (".zarray", "1.0.1"):
            f.write_bytes(b"spoilt")
    box = read_zarr(spark, str(tmp_path / "a"), (4, 0, 16), (8, 8, 30))
    assert {tuple(r)[:3]: r["v"] for r in box.collect()} == inside
    pushed = read_zarr(spark, str(tmp_path / "a")).where("z >= 4 AND z < 8 AND y <= 7 AND x > 15")
    assert {tuple(r)[:3]: r["v"] for r in pushed.collect()} == inside
    assert {tuple(r)[:3] for r in pushed.where("v > 4 AND x = 20").collect()} == {k for k, v in inside.items() if v > 4 and k[2] == 20}
    with pytest.raises(Exception):  # noqa: B017
        read_zarr(spark, str(tmp_path / "a")).collect()
    reader = ZarrReader({"path": str(tmp_path / "a"), "partitionbytes": "1", "zmin": "4", "zmax": "8", "ymax": "8", "xmin": "16"})
    assert [p.at for p in reader.partitions()] == [[(1, 0, 1)]]
    assert read_zarr(spark, str(tmp_path / "a")).where("z > 50").count() == 0


def test_broken_writes_leave_nothing(spark, tmp_path, voxels):
    _, df = voxels
    with pytest.raises(Exception, match="outside the array"):
        write_zarr(df.union(spark.createDataFrame([(99, 0, 0, 1.0)], df.schema)), str(tmp_path / "a"), SHAPE, CHUNKS)
    assert not (tmp_path / "a" / ".zarray").exists()
    assert not (tmp_path / "a" / "_pending").exists() or not list((tmp_path / "a" / "_pending").iterdir())
    write_zarr(df.limit(0), str(tmp_path / "e"), SHAPE, CHUNKS)
    assert read_zarr(spark, str(tmp_path / "e")).count() == 0
    with pytest.raises(ValueError):
        Layout.of({"shape": [1, 1, 1], "chunks": [1, 1, 1], "dtype": "|u1", "compressor": {"id": "blosc"}})


def test_reads_are_tried_again(tmp_path, monkeypatch):
    (tmp_path / "f").write_bytes(b"here")
    folder = Folder(str(tmp_path), attempts=3, wait=0.0)
    real, calls = folder._open, []

    def flaky():
        system, base = real()

        class Broken:
            def open_input_stream(self, path):
                calls.append(path)
                if len(calls) < 3:
                    raise OSError("reset")
                return system.open_input_stream(path)

        return Broken(), base

    monkeypatch.setattr(folder, "_open", flaky)
    assert folder.read("f") == b"here" and len(calls) == 3
    calls.clear()
    monkeypatch.setattr(folder, "attempts", 2)
    with pytest.raises(OSError):
        folder.read("f")
    assert Folder(str(tmp_path)).read("none") is None


def test_meshes_read_back_and_broken_ones_are_counted(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"w{k:03d}", r, c, 1.0 + r, 2.5 + c, float(rng.randrange(1, 99))) for k in range(4) for r in range(5 + k) for c in range(6) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "uuid string, row long, col long, z double, y double, x double").repartition(3)
    path = str(tmp_path / "m")
    write_meshes(df, path)
    assert sorted(map(tuple, read_meshes(spark, path).collect())) == sorted(rows)
    meta = json.loads((tmp_path / "m" / "w001" / "meta.json").read_text())
    have = {(r[1], r[2]) for r in rows if r[0] == "w001"}
    quads = sum({(r, c), (r + 1, c), (r, c + 1), (r + 1, c + 1)} <= have for r, c in have)
    assert meta["area_vx2"] == quads * 4096 and meta["uuid"] == "w001"
    (tmp_path / "m" / "w000" / "x.tif").write_bytes(b"II*\0 broken")
    (tmp_path / "m" / "w002" / "y.tif").unlink()
    assert {r["uuid"] for r in read_meshes(spark, path).collect()} == {"w001", "w003"}
    report = {r["uuid"]: (r["vertices"], r["error"]) for r in mesh_report(spark, path, "w[0-9]*").collect()}
    assert report["w002"] == (0, "no y.tif") and "TIFF" in report["w000"][1]
    assert report["w001"] == (sum(r[0] == "w001" for r in rows), None)
    with pytest.raises(Exception, match="FileExists"):
        write_meshes(df.where("uuid = 'w003'"), path)
    write_meshes(df.where("uuid = 'w002'"), path, overwrite=True)
    assert read_meshes(spark, path, "w002").count() == sum(r[0] == "w002" for r in rows)
    with pytest.raises(Exception, match="no name"):
        write_meshes(df.withColumn("uuid", F.lit("../x")), path)


def test_tiff_pictures():
    p = np.arange(12, dtype=np.float32).reshape(3, 4) - 1
    assert np.array_equal(read_tiff(tiff(p)), p)
    for bad in (b"", b"II*\0", tiff(p)[:30], b"II*\0" + b"\xff" * 40):
        with pytest.raises(ValueError):
            read_tiff(bad)
