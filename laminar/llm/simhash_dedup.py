"""Operator 7: near-duplicate documents by SimHash fingerprints and pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminar.graph import connected_components
from laminar.llm.arrow_text import slices, word_lists
from laminar.llm.pigeonhole import hamming_links
from laminar.storage import stage

SEED = 42


def _hashes(shingles: list[str]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), dtype=np.uint64, count=len(shingles))


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _pack(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64).ravel()


def simhash(texts: pa.Array, k: int = 3, chunk: int = 200_000) -> np.ndarray:
    """Fingerprints of texts (signed longs): majority of the bits of XXH64 over ``k``-word shingles.

    Shingles are made and voted ``chunk`` words at a time; the words of a text, and eight bytes for each, are held whole.
    """
    flat, offsets = word_lists(pc.ascii_lower(texts))
    counts = np.diff(offsets)
    out = np.zeros(len(counts), dtype=np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    ones = np.zeros((len(counts), 64), dtype=np.int64)
    for at in range(0, len(flat) - k + 1, chunk):
        n = min(chunk, len(flat) - k + 1 - at)
        whole = owner[at : at + n] == owner[at + k - 1 : at + k - 1 + n]
        if not whole.any():
            continue
        keep = pa.array(whole)
        columns = [flat.slice(at + j, n).filter(keep) for j in range(k)]
        bits = _bits(_hashes(pc.binary_join_element_wise(*columns, " ").to_pylist()))
        who = owner[at : at + n][whole]
        first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        ones[who[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    long = counts >= k
    out[long] = _pack(2 * ones[long] > (counts[long] - k + 1)[:, None])
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole_texts = [" ".join(flat.slice(offsets[d], counts[d]).to_pylist()) for d in short]
        out[short] = _hashes(whole_texts).view(np.int64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, slice_bytes: int = 4 << 20) -> DataFrame:
    """Rows ``(id_col, text_hash, fp)``; a null text, or one without words, has fingerprint 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col), F.xxhash64(text).alias("text_hash"), text.alias("__text"))
    id_type = narrow.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2), slice_bytes):
                made = simhash(batch.column(2).slice(a, b - a), k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(made)], names=[id_col, "text_hash", "fp"])

    return narrow.mapInArrow(run, f"`{id_col}` {id_type}, text_hash long, fp long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3, k: int = 3, crowd: int = 64) -> DataFrame:
    """One row per row of ``docs``: ``(id_col, text_hash, fp, root, component_id)``.

    Texts link when their fingerprints differ in at most ``max_bits`` bits; ``component_id`` is the
    smallest id that links reach, itself included, and ``root`` names the group by its smallest
    fingerprint. Equal fingerprints are one node, so copies cost nothing beyond their row. Rows with a
    null id take part in linking and get their component's smallest id (null where no row of it has one).
    Repeated ids give a row each. An empty table gives no rows.
    """
    made = stage(fingerprints(docs, id_col, text_col, k), "fp")
    nodes = stage(made.groupBy("fp").agg(F.min(id_col).alias("low")), "fpnodes")
    found = connected_components(hamming_links(nodes.select("fp"), max_bits, crowd))
    linked = nodes.join(found.withColumnRenamed("node", "fp"), "fp")
    lowest = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    settled = linked.join(lowest, "component").select("fp", "component", "component_id")
    of = nodes.join(settled, "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"), F.coalesce("component_id", "low").alias("component_id"))
    of = stage(of, "fpmap")  # both sides of the last join then are plain exchanges, which AQE can split
    return made.join(of, "fp").select(id_col, "text_hash", "fp", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id, null last, then the smallest text hash.

    Exact repeats of that row are dropped too (rows agreeing on id and text are taken as the same).
    """
    return keep_first(docs, stage(simhash_groups(docs, id_col, text_col, max_bits), "groups"), id_col, text_col)


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The first row of each group of ``groups`` (``id_col, text_hash, root``, staged), as ``drop_near_duplicates`` keeps it."""
    order = F.min(F.struct(F.col(id_col).isNull().alias("z"), F.col(id_col).alias("i"), F.col("text_hash").alias("t"))).alias("k")
    keep = groups.groupBy("root").agg(order).select(F.col("k.i").alias("i"), F.col("k.t").alias("t"))
    match = lambda a, b: (F.col(f"{a}.t") == F.col(f"{b}.t")) & F.col(f"{a}.i").eqNullSafe(F.col(f"{b}.i"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("i"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    kept = rows.alias("a").join(keep.alias("b"), match("a", "b"), "left_semi")
    repeats = groups.groupBy(F.col(id_col).alias("i"), F.col("text_hash").alias("t")).count().where("count > 1").drop("count")
    if repeats.head(1):
        once = kept.alias("a").join(repeats.alias("b"), match("a", "b"), "left_anti")
        several = kept.alias("a").join(repeats.alias("b"), match("a", "b"), "left_semi").dropDuplicates(["i", "t"])
        kept = once.unionByName(several)
    return kept.select([F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
