"""Meshes of grid vertices as a Spark data source: a folder a mesh, a float picture (TIFF) a coordinate, ``meta.json``.

Rows are vertices ``uuid, row, col, z, y, x``. A mesh is written by the task that holds its rows, under a pending name, reread and
compared there, and moved into place when all tasks have succeeded. Vertices that a grid does not have are stored as -1.
"""

from __future__ import annotations

import fnmatch
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from laminar.session import ship
from laminar.sources.files import Folder, pending
from laminar.sources.zarr_source import _folder

VERTEX = "uuid string, row long, col long, z double, y double, x double"
FOUND = "uuid string, vertices long, error string"
AXES = ("z", "y", "x")


def tiff(picture: np.ndarray) -> bytes:
    """A baseline TIFF of one strip of 32-bit floats."""
    ny, nx = picture.shape
    data = picture.astype("<f4").tobytes()
    at = 8 + len(data)
    # width, height, bits, compression (none), photometric (black is zero), strip offset, samples, rows a strip, strip bytes, sample format (float)
    entries = [(256, 4, nx), (257, 4, ny), (258, 3, 32), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, ny), (279, 4, len(data)), (339, 3, 3)]
    table = b"".join(struct.pack("<HHII", tag, kind, 1, value) for tag, kind, value in entries)
    return b"II*\0" + struct.pack("<I", at) + data + struct.pack("<H", len(entries)) + table + struct.pack("<I", 0)


def read_tiff(data: bytes) -> np.ndarray:
    """The first picture of an uncompressed TIFF of 32-bit floats, in strips; anything else is a ValueError."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF")
    end = "<" if data[:2] == b"II" else ">"
    try:
        at = struct.unpack(end + "I", data[4:8])[0]
        tags = {}
        for k in range(struct.unpack(end + "H", data[at : at + 2])[0]):
            tag, kind, count = struct.unpack(end + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
            form = {3: "H", 4: "I"}.get(kind)
            if form is None:
                continue
            size = struct.calcsize(form) * count
            place = at + 10 + 12 * k if size <= 4 else struct.unpack(end + "I", data[at + 10 + 12 * k : at + 14 + 12 * k])[0]
            tags[tag] = struct.unpack(f"{end}{count}{form}", data[place : place + size])
        if (tags.get(259, (1,)), tags[258], tags.get(339, (1,)), tags.get(277, (1,))) != ((1,), (32,), (3,), (1,)):
            raise ValueError("only uncompressed pictures of 32-bit floats are read")
        whole = b"".join(data[a : a + n] for a, n in zip(tags[273], tags[279], strict=True))
        return np.frombuffer(whole, dtype=f"{end}f4").reshape(tags[257][0], tags[256][0]).astype(np.float32)
    except (struct.error, KeyError) as e:
        raise ValueError("broken TIFF") from e


@dataclass
class Mesh(ds.InputPartition):
    uuids: list[str]


class MeshReader(ds.DataSourceReader):
    def __init__(self, options, report: bool) -> None:
        self.folder, self.glob, self.report = _folder(options), options.get("glob", "*"), report
        self.each = int(options.get("meshesperpartition", "16"))

    def partitions(self) -> list[Mesh]:
        names = [n for n in self.folder.names() if not n.startswith("_") and fnmatch.fnmatch(n, self.glob)]
        return [Mesh(names[k : k + self.each]) for k in range(0, len(names), self.each)] or [Mesh([])]

    def _one(self, uuid: str) -> tuple[np.ndarray | None, str | None]:
        parts = []
        for c in AXES:
            data = self.folder.read(f"{uuid}/{c}.tif")
            if data is None:
                return None, f"no {c}.tif"
            try:
                parts.append(read_tiff(data))
            except ValueError as e:
                return None, f"{c}.tif: {e}"
        if len({p.shape for p in parts}) > 1:
            return None, "pictures of different sizes"
        return np.stack(parts), None

    def read(self, partition: Mesh) -> Iterator[pa.RecordBatch]:
        for uuid in partition.uuids:
            grid, error = self._one(uuid)
            valid = np.zeros((0, 0), bool) if grid is None else (grid > 0).all(0)
            if self.report:
                yield pa.RecordBatch.from_arrays([pa.array([uuid]), pa.array([int(valid.sum())]), pa.array([error], type=pa.string())], names=["uuid", "vertices", "error"])
            elif grid is not None and valid.any():
                row, col = np.nonzero(valid)
                at = [pa.array(grid[k][row, col].astype(np.float64)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([uuid] * len(row)), pa.array(row, type=pa.int64()), pa.array(col, type=pa.int64()), *at], names=["uuid", "row", "col", *AXES])


@dataclass
class Written(ds.WriterCommitMessage):
    uuids: list[str]


class MeshWriter(ds.DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool) -> None:
        self.folder, self.overwrite, self.pending = _folder(options), overwrite, pending()
        self.step = float(options.get("step", "64"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows of a mesh must follow each other; one mesh is held at a time."""
        done: list[str] = []
        held: list[pa.RecordBatch] = []

        def put() -> None:
            if held:
                uuid = held[0].column("uuid")[0].as_py()
                if uuid in done:
                    raise ValueError(f"rows of mesh {uuid} do not follow each other")
                self._mesh(uuid, pa.Table.from_batches(held))
                done.append(uuid)
                held.clear()

        for batch in iterator:
            uuids = batch.column("uuid").to_pylist()
            start = 0
            for k in range(1, len(uuids) + 1):
                if k == len(uuids) or uuids[k] != uuids[start]:
                    if held and held[0].column("uuid")[0].as_py() != uuids[start]:
                        put()
                    held.append(batch.slice(start, k - start))
                    start = k
        put()
        return Written(done)

    def _mesh(self, uuid: str, vertices: pa.Table) -> None:
        if not uuid or "/" in uuid or uuid.startswith(("_", ".")):
            raise ValueError(f"{uuid!r} is no name for a mesh")
        row, col = (vertices.column(c).to_numpy() for c in ("row", "col"))
        if min(row.min(), col.min()) < 0:
            raise ValueError(f"mesh {uuid}: a vertex lies outside the grid")
        grid = np.full((3, row.max() + 1, col.max() + 1), -1, np.float32)
        for k, c in enumerate(AXES):
            grid[k, row, col] = vertices.column(c).to_numpy()
        for k, c in enumerate(AXES):
            name = f"{self.pending}/{uuid}/{c}.tif"
            self.folder.write(name, tiff(grid[k]))
            if not np.array_equal(read_tiff(self.folder.read(name) or b""), grid[k]):
                raise OSError(f"mesh {uuid}: {c}.tif does not read back as written")
        valid = (grid > 0).all(0)
        quads = int((valid[:-1, :-1] & valid[1:, :-1] & valid[:-1, 1:] & valid[1:, 1:]).sum())
        at = grid[:, valid][::-1]
        box = [at.min(1).tolist(), at.max(1).tolist()] if valid.any() else None
        meta = {"format": "tifxyz", "type": "seg", "uuid": uuid, "scale": [1 / self.step] * 2, "bbox": box, "area_vx2": quads * self.step**2, "area_cm2": quads * self.step**2 * 8.64**2 / 1e8}
        self.folder.write(f"{self.pending}/{uuid}/meta.json", json.dumps(meta).encode())

    def commit(self, messages: list[Written | None]) -> None:
        uuids = [u for m in messages if m is not None for u in m.uuids]
        there = set(self.folder.names())
        if len(uuids) != len(set(uuids)):
            self.abort(messages)
            raise ValueError("a mesh was written by two tasks")
        if there & set(uuids) and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(", ".join(sorted(there & set(uuids))[:5]))
        for uuid in uuids:
            if uuid in there:
                self.folder.remove(uuid)
            self.folder.move(f"{self.pending}/{uuid}", uuid)
        self.folder.remove("_pending")

    def abort(self, messages: list[Written | None]) -> None:
        self.folder.remove(self.pending)


class MeshSource(ds.DataSource):
    """``format("laminar_mesh")``: options path, attempts, wait; read: glob, meshesPerPartition, report (a row a folder, with its error,
    rather than its vertices); write: step."""

    @classmethod
    def name(cls) -> str:
        return "laminar_mesh"

    def _report(self) -> bool:
        return self.options.get("report", "false").lower() == "true"

    def schema(self) -> str:
        return FOUND if self._report() else VERTEX

    def reader(self, schema) -> MeshReader:
        return MeshReader(self.options, self._report())

    def writer(self, schema, overwrite: bool) -> MeshWriter:
        return MeshWriter(self.options, overwrite)


def read_meshes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Vertices with positive coordinates of all readable meshes; ``mesh_report`` names the others."""
    ship(spark).dataSource.register(MeshSource)
    return spark.read.format("laminar_mesh").options(path=path, glob=glob).load()


def mesh_report(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``uuid, vertices, error``: a row a folder; ``error`` is null where the mesh is readable."""
    ship(spark).dataSource.register(MeshSource)
    return spark.read.format("laminar_mesh").options(path=path, glob=glob, report="true").load()


def write_meshes(vertices: DataFrame, path: str, step: float = 64.0, overwrite: bool = False) -> None:
    """A folder a mesh from ``uuid, row, col, z, y, x``; rows are dealt by mesh, whose grid is one task's."""
    ship(vertices.sparkSession).dataSource.register(MeshSource)
    rows = vertices.selectExpr("uuid", "CAST(row AS long) AS row", "CAST(col AS long) AS col", *[f"CAST({c} AS double) AS {c}" for c in AXES])
    dealt = rows.repartition("uuid").sortWithinPartitions("uuid", "row", "col")
    dealt.write.format("laminar_mesh").options(path=path, step=str(step)).mode("overwrite" if overwrite else "append").save()
