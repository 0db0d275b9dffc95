"""Zarr (version 2) arrays of three dimensions as a Spark data source.

Rows are voxels ``z, y, x, v`` other than the fill value. Chunks are the unit of reading: a partition is a run of chunks, and
comparisons of z, y or x with literals are pushed down to a box, so that chunks outside are never opened. Writing takes rows
whose chunks are whole within a task (``write_zarr`` deals them so), puts each chunk under a pending name, and moves all into
place, with the array's description last, when every task has succeeded.
"""

from __future__ import annotations

import gzip
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from laminar.session import ship
from laminar.sources.files import Folder, pending

AXES = ("z", "y", "x")
ROW = "z long, y long, x long, v double"
_CODECS = {None: (lambda b: b, lambda b: b), "zlib": (zlib.decompress, zlib.compress), "gzip": (gzip.decompress, gzip.compress)}


def _folder(options) -> Folder:
    return Folder(options["path"].rstrip("/"), int(options.get("attempts", "6")), float(options.get("wait", "0.5")))


@dataclass
class Layout:
    """What ``.zarray`` says."""

    shape: list[int]
    chunks: list[int]
    dtype: str
    codec: str | None
    fill: float
    separator: str
    order: str = "C"

    @staticmethod
    def of(meta: dict) -> Layout:
        codec = (meta.get("compressor") or {}).get("id")
        if codec not in _CODECS or meta.get("filters"):
            raise ValueError(f"chunks with compressor {codec} or filters are not read")
        if len(meta["shape"]) != 3:
            raise ValueError("arrays of three dimensions are read")
        return Layout(meta["shape"], meta["chunks"], meta["dtype"], codec, meta.get("fill_value") or 0, meta.get("dimension_separator", "."), meta.get("order", "C"))

    def meta(self) -> dict:
        codec = self.codec and {"id": self.codec, "level": 5}
        return {"zarr_format": 2, "shape": self.shape, "chunks": self.chunks, "dtype": self.dtype, "compressor": codec, "fill_value": self.fill, "filters": None, "order": self.order, "dimension_separator": self.separator}

    def name(self, at: tuple[int, ...]) -> str:
        return self.separator.join(map(str, at))

    def grid(self, box: list[list[int]]) -> list[tuple[int, int, int]]:
        """Chunks that meet a box (upper bounds exclusive)."""
        spans = [range(max(a, 0) // c, -(-min(b, s) // c)) for (a, b), c, s in zip(box, self.chunks, self.shape, strict=True)]
        return list(product(*spans))

    def decode(self, data: bytes) -> np.ndarray:
        return np.frombuffer(_CODECS[self.codec][0](data), dtype=self.dtype).reshape(self.chunks, order=self.order)

    def encode(self, block: np.ndarray) -> bytes:
        return _CODECS[self.codec][1](block.astype(self.dtype).tobytes(order=self.order))


@dataclass
class Chunks(ds.InputPartition):
    at: list[tuple[int, int, int]]


class ZarrReader(ds.DataSourceReader):
    def __init__(self, options) -> None:
        self.folder = _folder(options)
        text = self.folder.read(".zarray")
        if text is None:
            raise FileNotFoundError(f"no .zarray in {self.folder.address}")
        self.layout = Layout.of(json.loads(text))
        self.box = [[0, s] for s in self.layout.shape]
        self.bytes = int(options.get("partitionbytes", str(64 << 20)))
        for c, axis in enumerate(AXES):  # bounds as options, for sessions that do not push filters down
            self._narrow(c, int(options.get(f"{axis}min", "0")), int(options.get(f"{axis}max", str(self.layout.shape[c]))))

    def _narrow(self, c: int, low: float, high: float) -> None:
        self.box[c] = [max(self.box[c][0], low), min(self.box[c][1], high)]

    def partitions(self) -> list[Chunks]:
        """Runs of chunks of about ``partitionBytes`` decoded bytes, one chunk at least; a box outside the array has none."""
        size = int(np.prod(self.layout.chunks)) * np.dtype(self.layout.dtype).itemsize
        each = max(1, self.bytes // size)
        grid = self.layout.grid(self.box) if all(a < b for a, b in self.box) else []
        return [Chunks(grid[k : k + each]) for k in range(0, len(grid), each)] or [Chunks([])]

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        names = [*AXES, "v"]
        for at in partition.at:
            data = self.folder.read(self.layout.name(at))
            if data is None:
                continue  # a chunk that was never written holds the fill value only
            origin = [k * c for k, c in zip(at, self.layout.chunks, strict=True)]
            cut = tuple(slice(max(a - o, 0), max(min(b, s) - o, 0)) for o, (a, b), s in zip(origin, self.box, self.layout.shape, strict=True))
            block = self.layout.decode(data)[cut]
            where = np.nonzero(block != self.layout.fill)
            v = block[where].astype(np.float64)
            columns = [w + o + c.start for w, o, c in zip(where, origin, cut, strict=True)]
            for k in range(0, len(v), 65_536):
                yield pa.RecordBatch.from_arrays([*[pa.array(c[k : k + 65_536], type=pa.int64()) for c in columns], pa.array(v[k : k + 65_536])], names=names)


class PushingZarrReader(ZarrReader):
    """For sessions that push filters down to Python data sources; in others Spark refuses a reader that takes them."""

    def pushFilters(self, filters: list[ds.Filter]):
        for f in filters:
            axis = AXES.index(f.attribute[0]) if getattr(f, "attribute", None) and len(f.attribute) == 1 and f.attribute[0] in AXES else None
            value = getattr(f, "value", None)
            if isinstance(f, ds.IsNotNull) and axis is not None:
                continue  # coordinates never are
            whole = axis is not None and isinstance(value, int) and not isinstance(value, bool)
            if whole and isinstance(f, ds.EqualTo):
                self._narrow(axis, value, value + 1)
            elif whole and isinstance(f, ds.GreaterThanOrEqual):
                self._narrow(axis, value, self.box[axis][1])
            elif whole and isinstance(f, ds.GreaterThan):
                self._narrow(axis, value + 1, self.box[axis][1])
            elif whole and isinstance(f, ds.LessThanOrEqual):
                self._narrow(axis, self.box[axis][0], value + 1)
            elif whole and isinstance(f, ds.LessThan):
                self._narrow(axis, self.box[axis][0], value)
            else:
                yield f


@dataclass
class Written(ds.WriterCommitMessage):
    names: list[str]


class ZarrWriter(ds.DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool) -> None:
        self.folder, self.overwrite, self.pending = _folder(options), overwrite, pending()
        numbers = lambda key: [int(n) for n in options[key].split(",")]
        self.layout = Layout(numbers("shape"), numbers("chunks"), options.get("dtype", "<i4"), options.get("codec", "zlib") if options.get("codec", "zlib") != "none" else None, 0, ".")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows of a chunk must follow each other."""
        layout, done = self.layout, []
        at, block = None, None

        def put() -> None:
            if at is not None:
                if layout.name(at) in done:
                    raise ValueError(f"rows of chunk {layout.name(at)} do not follow each other")
                self.folder.write(f"{self.pending}/{layout.name(at)}", layout.encode(block))
                done.append(layout.name(at))

        for batch in iterator:
            place = np.stack([batch.column(c).to_numpy() for c in AXES], 1)
            v = batch.column("v").to_numpy(zero_copy_only=False)
            if len(place) and ((place < 0) | (place >= layout.shape)).any():
                raise ValueError("a voxel lies outside the array")
            chunk = place // layout.chunks
            starts = np.flatnonzero(np.concatenate([[True], (chunk[1:] != chunk[:-1]).any(1)])) if len(place) else []
            for a, b in zip(starts, [*starts[1:], len(place)], strict=True):
                here = tuple(int(k) for k in chunk[a])
                if here != at:
                    put()
                    at, block = here, np.zeros(layout.chunks)
                block[tuple((place[a:b] - chunk[a] * layout.chunks).T)] = v[a:b]
        put()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        names = [n for m in messages if m is not None for n in m.names]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("a chunk was written by two tasks")
        if self.folder.read(".zarray") is not None and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.folder.address)
        for name in names:
            self.folder.move(f"{self.pending}/{name}", name)
        self.folder.write(".zarray", json.dumps(self.layout.meta()).encode())
        self.folder.remove("_pending")

    def abort(self, messages: list[Written | None]) -> None:
        self.folder.remove(self.pending)


class ZarrSource(ds.DataSource):
    """``format("laminar_zarr")``: options path, attempts, wait; read: pushdown (where the session allows it), partitionBytes, zMin, zMax and so on (upper bounds exclusive);
    write: shape, chunks (three numbers), dtype, codec (zlib, gzip, none)."""

    @classmethod
    def name(cls) -> str:
        return "laminar_zarr"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> ZarrReader:
        return (PushingZarrReader if self.options.get("pushdown", "false") == "true" else ZarrReader)(self.options)

    def writer(self, schema, overwrite: bool) -> ZarrWriter:
        return ZarrWriter(self.options, overwrite)


def read_zarr(spark: SparkSession, path: str, low: tuple | None = None, high: tuple | None = None, **options: str) -> DataFrame:
    """``z, y, x, v``: voxels other than the fill value, within a box if one is given (``high`` exclusive). Filters on z, y and x are
    pushed down where ``spark.sql.python.filterPushdown.enabled`` is set."""
    ship(spark).dataSource.register(ZarrSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("laminar_zarr").options(path=path, pushdown=pushdown, **options)
    for name, bounds in (("Min", low), ("Max", high)):
        for axis, value in zip(AXES, bounds or (), strict=False):
            reader = reader.option(f"{axis}{name}", str(value))
    return reader.load()


def write_zarr(voxels: DataFrame, path: str, shape: tuple[int, int, int], chunks: tuple[int, int, int], dtype: str = "<i4", codec: str = "zlib", overwrite: bool = False) -> None:
    """``z, y, x, v`` as an array, zero elsewhere. Rows are dealt by chunk, so a task holds one chunk at a time; a voxel given
    twice keeps one of its values."""
    ship(voxels.sparkSession).dataSource.register(ZarrSource)
    of = [F.floor(F.col(c) / n).cast("long").alias(f"c{c}") for c, n in zip(AXES, chunks, strict=True)]
    keyed = voxels.select(*[F.col(c).cast("long").alias(c) for c in AXES], F.col("v").cast("double").alias("v"), *of)
    dealt = keyed.repartition("cz", "cy", "cx").sortWithinPartitions("cz", "cy", "cx").select(*AXES, "v")
    numbers = lambda t: ",".join(map(str, t))
    options = {"path": path, "shape": numbers(shape), "chunks": numbers(chunks), "dtype": dtype, "codec": codec}
    dealt.write.format("laminar_zarr").options(**options).mode("overwrite" if overwrite else "append").save()
