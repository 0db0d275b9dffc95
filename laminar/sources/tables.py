"""Readers for the formats that instance data comes in. All reading is done by Spark's own file sources."""

from __future__ import annotations

import io
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminar.session import ship

LABEL_VOXEL = "slab_z0 long, tile_y0 long, tile_x0 long, zl long, yl long, xl long, local_id long"
FRAME = 65_536  # voxels handed on together
CHUNK = "z0 long, y0 long, x0 long, nz long, ny long, nx long, data binary"


def with_retry(read: Callable, attempts: int = 6, wait: float = 5.0):
    """Result of ``read()``, tried again with doubling waits; the last error is raised."""
    for k in range(attempts):
        try:
            return read()
        except OSError:
            if k == attempts - 1:
                raise
            time.sleep(wait * 2**k)


def list_files(spark: SparkSession, path: str, delimiter: str = "/") -> DataFrame:
    """``prefix, files, bytes`` below ``path``, by the first name after it. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    rest = F.regexp_extract("path", r"^[a-z]+:/*(.*)$", 1)
    base = path.split("://")[-1].lstrip("/").rstrip("/") + "/"
    below = F.substring_index(rest, base, -1)
    return found.select(F.substring_index(below, delimiter, 1).alias("prefix"), "length").groupBy("prefix").agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).orderBy("prefix")


def file_times(spark: SparkSession, path: str) -> DataFrame:
    """``name, bytes, modified, modified_utc``: the files below ``path`` with their time of change, as a timestamp and as text in UTC.
    Contents are not read. Empty files are not listed (Spark's file sources pass over them)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = found.select("_metadata.file_name", "_metadata.file_size", "_metadata.file_modification_time")
    text = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("file_modification_time").cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss")
    return found.select(F.col("file_name").alias("name"), F.col("file_size").alias("bytes"), F.col("file_modification_time").alias("modified"), F.concat(text, F.lit(" UTC")).alias("modified_utc"))


def _block_voxels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Labelled voxels of blocks (``slab_z0, tile_y0, tile_x0, content``), those of many small blocks in one frame."""

    def frame(parts: list) -> pd.DataFrame:
        return pd.DataFrame({c: np.concatenate(v) for c, v in zip(("slab_z0", "tile_y0", "tile_x0", "zl", "yl", "xl", "local_id"), zip(*parts, strict=True), strict=True)})

    parts, n = [], 0
    for batch in batches:
        for row in batch.itertuples(index=False):
            labels = np.load(io.BytesIO(row.content))["labels"]
            step = max(1, FRAME // max(1, labels[:1].size))
            for z0 in range(0, len(labels), step):  # some planes at a time bound the memory
                z, y, x = np.nonzero(labels[z0 : z0 + step])
                z = z + z0
                parts.append([*(np.full(len(z), v, dtype=np.int64) for v in (row.slab_z0, row.tile_y0, row.tile_x0)), z, y, x, labels[z, y, x].astype(np.int64)])
                n += len(z)
                if n >= FRAME:
                    yield frame(parts)
                    parts, n = [], 0
    if n:
        yield frame(parts)


def read_label_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Sparse label voxels from ``.../z<Z>/tile_y<Y>_x<X>.npz`` blocks; one block is one row of the file source."""
    files = ship(spark).read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npz").load(path)
    name = [F.regexp_extract("path", p, 1).cast("long").alias(c) for c, p in (("slab_z0", r"/z(\d+)/"), ("tile_y0", r"tile_y(\d+)_x"), ("tile_x0", r"_x(\d+)\.npz$"))]

    return files.select(*name, "content").mapInPandas(_block_voxels, LABEL_VOXEL)


def read_chunks(spark: SparkSession, path: str, meta: dict) -> DataFrame:
    """Chunks of a zarr (version 2) array: origin, size and C-ordered bytes; ``meta`` is the content of
    its ``.zarray`` (Spark's file sources skip names that begin with a dot).

    Uncompressed, zlib and gzip chunks are read. Chunk files are rows of Spark's file source, so a box is
    read by filtering on the origins before the bytes are touched.
    """
    sep = meta.get("dimension_separator", ".")
    (sz, sy, sx), (cz, cy, cx) = meta["shape"], meta["chunks"]
    codec = (meta.get("compressor") or {}).get("id")
    if codec not in (None, "zlib", "gzip"):
        raise ValueError(f"chunks compressed with {codec} are not read")
    index = r"(\d+)" + (r"\." if sep == "." else "/") + r"(\d+)" + (r"\." if sep == "." else "/") + r"(\d+)$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(index))
    at = [(F.regexp_extract("path", index, k + 1).cast("long") * c).alias(n) for k, (n, c) in enumerate((("z0", cz), ("y0", cy), ("x0", cx)))]
    size = [F.least(F.lit(c), F.lit(s) - F.col(o)).cast("long").alias(n) for n, o, c, s in (("nz", "z0", cz, sz), ("ny", "y0", cy, sy), ("nx", "x0", cx, sx))]

    @F.pandas_udf("binary")
    def plain(content: pd.Series) -> pd.Series:
        return content.map(lambda b: b if codec is None else zlib.decompress(b, 47))

    return files.select(*at, "content").select("z0", "y0", "x0", *size, plain("content").alias("data"))


def read_box(chunks: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int], shape: tuple[int, int, int], dtype: str = "uint8") -> DataFrame:
    """``z, y, x, v``: non-zero voxels inside a box (upper bounds exclusive); chunks outside are filtered first."""
    hit = chunks
    for o, n, a, b in zip(("z0", "y0", "x0"), ("nz", "ny", "nx"), low, high, strict=True):
        hit = hit.where((F.col(o) < b) & (F.col(o) + F.col(n) > a))

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                block = np.frombuffer(r.data, dtype=dtype).reshape(shape)[: r.nz, : r.ny, : r.nx]
                z, y, x = np.nonzero(block)
                out = pd.DataFrame({"z": z + r.z0, "y": y + r.y0, "x": x + r.x0, "v": block[z, y, x].astype(np.int64)})
                for c, a, b in zip("zyx", low, high, strict=True):
                    out = out[(out[c] >= a) & (out[c] < b)]
                yield out

    return hit.mapInPandas(explode, "z long, y long, x long, v long")


def read_id_maps(spark: SparkSession, path: str) -> DataFrame:
    """``tile, local_id, gid`` from JSON tables of tables ``{tile: {local: id}}``; unreadable files give no rows."""
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    maps = text.select(F.explode(F.from_json("value", "map<string,map<string,bigint>>")).alias("tile", "ids"))
    return maps.select("tile", F.explode("ids").alias("local", "gid")).select("tile", F.col("local").cast("long").alias("local_id"), "gid")


def tile_key(tile) -> list:
    """Columns slab_z0 (null without one), tile_y0, tile_x0 of keys such as ``z224/y448_x0``."""
    part = lambda p, n: F.try_to_number(F.nullif(F.regexp_extract(tile, p, 1), F.lit("")), F.lit("9999999999")).cast("long").alias(n)
    return [part(r"z(\d+)/", "slab_z0"), part(r"y(\d+)_x", "tile_y0"), part(r"_x(\d+)$", "tile_x0")]


def read_numbers(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Finite numbers of a CSV with a header; rows with a malformed or non-finite value are left out."""
    raw = spark.read.csv(path, header=True)
    cast = raw.select(*[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in columns])
    fine = None
    for c in columns:
        ok = F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
        fine = ok if fine is None else fine & ok
    return cast.where(fine)


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """``z, y, x`` of sites given as full-resolution ``gz, gy, gx`` (halved) or as ``z, y, x``."""
    raw = spark.read.csv(path, header=True)
    full = {"gz", "gy", "gx"} <= set(raw.columns)
    pick = [(F.expr(f"try_cast(`{'g' + c if full else c}` AS double)") / (2 if full else 1)).alias(c) for c in ("z", "y", "x")]
    return raw.select(*pick).where("z IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL")


def read_axis(spark: SparkSession, path: str) -> DataFrame:
    """``z, y, x`` control points, given as objects or as arrays, in the order of z; keys of the folders (``g=1``) are columns too."""
    text = spark.read.text(path, wholetext=True)
    keys = [c for c in text.columns if c != "value"]
    cp = text.select(*keys, F.expr("try_variant_get(try_parse_json(value), '$.control_points', 'variant')").alias("cp")).where("cp IS NOT NULL")
    one = cp.lateralJoin(spark.tvf.variant_explode(F.col("cp").outer())).select(*keys, F.col("value").alias("p"))
    pick = [F.coalesce(F.expr(f"try_variant_get(p, '$.{c}', 'double')"), F.expr(f"try_variant_get(p, '$[{k}]', 'double')")).alias(c) for k, c in enumerate("zyx")]
    return one.select(*keys, *pick).where("z IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL").orderBy(*keys, "z")


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """``doc, payload`` of constraint documents, one whole file a row, for the validator."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), F.col("value").alias("payload"))


def read_json_tables(spark: SparkSession, path: str, field: str) -> DataFrame:
    """The records of one array field of JSON files, e.g. ``patches`` or ``pcls`` of a satisfaction report."""
    return spark.read.json(path, multiLine=True).select(F.explode(field).alias("r")).select("r.*")
