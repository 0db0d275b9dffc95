"""Writers: partitioned label tables, JSON documents, appended CSV, and pictures of one slice."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_labels(labels: DataFrame, path: str, by: str = "slab_z0") -> None:
    """Label voxels as Parquet, a folder per slab: readers prune by it."""
    labels.write.mode("overwrite").partitionBy(by).parquet(path)


def write_label_blocks(labels: DataFrame, path: str, shape: tuple[int, int, int]) -> int:
    """Blocks ``z<Z>/tile_y<Y>_x<X>.npz`` of ``shape`` from ``slab_z0, tile_y0, tile_x0, zl, yl, xl, local_id``, and their number.

    A task goes through its tiles in order and holds one at a time, bounded by its shape; a block gets its name only when it is
    whole, so repeated tasks do no harm.
    """
    import io
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    from laminar.sources.files import Folder, pending

    folder = Folder(path)

    def save(tile: np.ndarray) -> None:
        block = np.zeros(shape, dtype=np.int32)
        block[tile[:, 3], tile[:, 4], tile[:, 5]] = tile[:, 6]
        at = tile[0, :3].tolist()
        data = io.BytesIO()
        np.savez_compressed(data, labels=block, z0=at[0], y0=at[1], x0=at[2])
        new = pending()
        folder.write(new, data.getvalue())
        folder.move(new, f"z{at[0]}/tile_y{at[1]}_x{at[2]}.npz")

    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = np.empty((0, 7), dtype=np.int64)
        for batch in batches:
            rows = np.concatenate([rest, batch.to_numpy(dtype=np.int64)])
            starts = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            *whole, rest = np.split(rows, starts)  # the last tile may go on in the next batch
            for tile in whole:
                save(tile)
            yield pd.DataFrame({"n": [len(whole)]})
        if len(rest):
            save(rest)
            yield pd.DataFrame({"n": [1]})

    key = ["slab_z0", "tile_y0", "tile_x0"]
    rows = labels.select(*key, "zl", "yl", "xl", "local_id").repartition(*key).sortWithinPartitions(*key)
    n = rows.mapInPandas(tiles, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    folder.remove("_pending")
    return n


def append_csv(rows: DataFrame, path: str, gzip: bool = False) -> None:
    """Rows added to a CSV folder with headers."""
    writer = rows.write.mode("append").option("header", "true")
    (writer.option("compression", "gzip") if gzip else writer).csv(path)


def id_map_json(ids: DataFrame) -> DataFrame:
    """One JSON document ``{tile: {local: id}}`` per slab: ``slab_z0, value``; a slab's table is one row."""
    inner = ids.groupBy("slab_z0", "tile").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("local_id").cast("string").alias("k"), "gid")))).alias("m"))
    outer = inner.groupBy("slab_z0").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tile", F.to_json("m").alias("j"))))).alias("m"))
    pieces = F.transform(F.map_entries("m"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"]))
    return outer.select("slab_z0", F.concat(F.lit("{"), F.array_join(pieces, ","), F.lit("}")).alias("value"))


def collection_json(points: DataFrame) -> DataFrame:
    """One point-collection document (``value``) from ``collection, name, point, z, y, x, wind_a`` rows.

    Points are written as x, y, z at full resolution; collections are numbered in the order given. The
    document is one value: it holds sampled points, bounded by their budget.
    """
    with_wind = F.when(F.col("wind_a").isNotNull(), F.to_json(F.struct(F.array("x", "y", "z").alias("p"), "wind_a"))).otherwise(F.to_json(F.struct(F.array("x", "y", "z").alias("p"))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("point", with_wind.alias("j")))), lambda e: F.concat(F.lit('"'), e["point"].cast("string"), F.lit('":'), e["j"])), ",")
    one = points.groupBy("collection", "name").agg(body.alias("b"))
    text = F.concat(F.lit('"'), F.col("collection").cast("string"), F.lit('":{"name":'), F.to_json(F.array("name")).substr(F.lit(2), F.length(F.to_json(F.array("name"))) - 2), F.lit(',"points":{'), F.col("b"), F.lit('},"metadata":{}}'))
    every = one.select("collection", text.alias("t")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("collection", "t"))), lambda e: e["t"]), ",").alias("all"))
    return every.select(F.concat(F.lit('{"vc_pointcollections_json_version":"1","collections":{'), F.col("all"), F.lit("}}")).alias("value"))


def axis_json(axis: DataFrame) -> DataFrame:
    """One axis document (``value``) from ``z, y, x`` rows, a point per slice."""
    points = F.array_sort(F.collect_list(F.struct("z", "y", "x")))
    return axis.agg(F.to_json(F.struct(points.alias("control_points"))).alias("value"))


def write_text(documents: DataFrame, path: str, by: str | None = None) -> None:
    """Documents (``value``) as lines, or a folder for each value of ``by`` where a document is to be a file of its own."""
    if by is None:
        documents.select("value").write.mode("overwrite").text(path)
    else:
        documents.select("value", by).repartition(by).write.mode("overwrite").partitionBy(by).text(path)


def colours(labels: DataFrame, label: str = "gid") -> DataFrame:
    """``labels`` with ``r, g, b``: a golden-ratio hue per label, black for none."""
    h = F.pmod(F.col(label) * 0.6180339887498949, F.lit(1.0)) * 6

    def channel(shift: int) -> Column:
        k = F.pmod(h + shift, F.lit(6.0))
        return F.when(F.coalesce(F.col(label), F.lit(0)) == 0, 0).otherwise(F.floor(255 * (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least(k, 4 - k)))))).cast("int")

    return labels.withColumns({"r": channel(5), "g": channel(3), "b": channel(1)})


def png(pixels: DataFrame, ny: int, nx: int) -> bytes:
    """A picture of one slice from ``y, x, r, g, b``. Rows of pixels are assembled by Spark and only the
    finished ``ny`` lines, whose size the picture fixes, come to the driver."""
    dot = F.struct("x", F.concat(*[F.substring(F.unhex(F.lpad(F.hex(c), 2, "0")), 1, 1) for c in "rgb"]).alias("v"))
    lines = {r["y"]: r["d"] for r in pixels.where(F.col("y").between(0, ny - 1) & F.col("x").between(0, nx - 1)).groupBy("y").agg(F.collect_list(dot).alias("d")).collect()}
    raw = bytearray()
    for y in range(ny):
        line = bytearray(3 * nx)
        for d in lines.get(y, []):
            line[3 * d["x"] : 3 * d["x"] + 3] = d["v"]
        raw += b"\0" + line

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", nx, ny, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(bytes(raw))) + part(b"IEND", b"")
