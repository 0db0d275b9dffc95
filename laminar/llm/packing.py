"""Operator 2: variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted at once. Documents are measured in words, cut into pieces of the
largest length, and dealt by hash into shards of a bounded number of pieces; each shard is packed by
itself with best-fit decreasing: a piece goes into the open bin that it leaves fullest, and where none
has room, every permitted size is filled in thought with the largest pieces that still wait, and the one
of least cost per word is opened: the sizes are chosen jointly with what is to go into them. At the end every bin is
downsized to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminar.llm.mixing import WORDS
from laminar.storage import stage

CAPACITIES = (256, 512, 1024, 2048)
SHARD_PIECES = 20_000
BIN_OVERHEAD = 24.0


def bin_cost(capacity: int, overhead: float = BIN_OVERHEAD, quadratic: float = 2e-5) -> float:
    """Cost of one sequence: its length, an overhead per sequence, and attention's square."""
    return overhead + capacity + quadratic * capacity * capacity


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each piece and final capacity of each bin; ``lengths`` are between 1 and the largest capacity.

    Open bins are found by their room in one machine integer used as a bit set, so that the tightest fit
    costs a shift and a mask.
    """
    capacities = tuple(sorted(capacities))
    costs = [bin_cost(c) for c in capacities]
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    bins = np.zeros(len(lengths), dtype=np.int64)
    used: list[int] = []
    stacks: dict[int, list[int]] = {}
    rooms = 0
    held = np.bincount(lengths.astype(np.int64), minlength=1).tolist() if len(lengths) else []
    left = sum(1 << n for n, c in enumerate(held) if c)  # lengths that still wait, as a bit set

    def price(capacity: int, n: int) -> float:
        """Cost per word of a bin of ``capacity`` opened for ``n``, filled with the largest waiting pieces that fit, then downsized."""
        full, waits, taken = n, left, {}
        while full < capacity and (fits := waits & ((2 << (capacity - full)) - 1)):
            m = fits.bit_length() - 1
            many = min((capacity - full) // m, held[m] - taken.get(m, 0))
            full += many * m
            taken[m] = taken.get(m, 0) + many
            waits &= ~(1 << m)
        return costs[next(i for i, c in enumerate(capacities) if c >= full)] / full

    for k in order:
        n = int(lengths[k])
        held[n] -= 1
        if not held[n]:
            left &= ~(1 << n)
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
        else:
            best = min((i for i, c in enumerate(capacities) if c >= n), key=lambda i: (price(capacities[i], n), i))
            b, room = len(used), capacities[best]
            used.append(0)
        bins[k] = b
        used[b] += n
        room -= n
        if room:
            stacks.setdefault(room, []).append(b)
            rooms |= 1 << room
    sizes = np.array(capacities)
    return bins, sizes[np.searchsorted(sizes, used)] if used else np.zeros(0, dtype=np.int64)


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece of a document: ``bin_id, capacity, used, slot, doc_id, text_hash, repeat, start, length``.

    ``start`` and ``length`` count words (runs of anything but ASCII white space) of the document's text;
    pieces of one document partition its words. ``repeat`` numbers rows that agree on id and text. A
    document without words (or with a null text) fills no bin: one row with null bin, capacity, used and
    slot. ``bin_id`` is ``shard:number``. The number of shards follows the number of pieces, so a shard
    has ``shard_pieces`` of them on average however large the table; the same rows give the same bins in
    any partitioning. Columns other than ``doc_id, text`` are not read. An empty table gives no rows.
    """
    most = max(capacities)
    n_words = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORDS))).cast("long")
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), n_words.alias("n"))
    units = stage(rows.groupBy("doc_id", "text_hash", "n").agg(F.count("*").alias("m")), "packunits")
    total = units.agg(F.sum(F.expr(f"m * greatest(1, ceil(n / {most}))")).alias("k")).first()["k"] or 0
    shards = max(1, -(-total // shard_pieces))
    single = units.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    cut = single.withColumn("start", F.explode(F.expr(f"sequence(0L, greatest(n - 1, 0), {most}L)")))
    cut = cut.withColumn("length", F.expr(f"least(n - start, {most}L)"))
    empty = cut.where("length = 0").select(
        *[F.lit(None).cast(t).alias(c) for c, t in (("bin_id", "string"), ("capacity", "int"), ("used", "int"), ("slot", "int"))], "doc_id", "text_hash", "repeat", "start", "length"
    )
    full = cut.where("length > 0").withColumn("shard", F.expr(f"pmod(xxhash64(doc_id, text_hash, repeat, start), {shards}L)"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def one(pieces: pd.DataFrame) -> pd.DataFrame:
        p = pieces.sort_values(["text_hash", "doc_id", "repeat", "start"], kind="stable").reset_index(drop=True)
        bins, sizes = pack(p["length"].to_numpy(), capacities)
        p["bin"] = bins
        p["used"] = p.groupby("bin")["length"].transform("sum")
        p["slot"] = p.groupby("bin").cumcount()
        p["capacity"] = sizes[bins]
        p["bin_id"] = p["shard"].astype(str) + ":" + p["bin"].astype(str)
        return p[["bin_id", "capacity", "used", "slot", "doc_id", "text_hash", "repeat", "start", "length"]]

    packed = full.select("shard", "doc_id", "text_hash", "repeat", "start", "length").groupBy("shard").applyInPandas(
        one, f"bin_id string, capacity int, used int, slot int, doc_id {id_type}, text_hash long, repeat long, start long, length long"
    )
    return packed.unionByName(empty)
