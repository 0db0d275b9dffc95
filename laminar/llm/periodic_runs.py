"""Operator 11: runs of words that repeat with a period of at least four turns, by seeds on diagonals.

A run of period q and length L (at least four q) matches itself q words on over L - q >= 3q words: that is its stretch of
the diagonal q. Lags are taken by doubling classes Q <= q < 2Q. Each class has its own seed length, the 2Q words that any
such stretch is guaranteed to hold, and indexes the grams of that length per text. Where q is the smallest period, a gram
of q - 1 words or more recurs within the run after q words and not before (else the run had a smaller period too), so the
pairs of an occurrence with the next one in the same text hold every seed of every run, and a text gives no more pairs
than it has words, however often a gram stands in it. Seeds are followed along their diagonal: a table per lag of the
furthest place covered, here the seeds in order of lag and place, lets a seed that its predecessor has covered start
nothing, so that a run is extended once. Grams that do not recur in their text are left out of the longer ones, whose
numbers are made of two halves each (Karp, Miller and Rosenberg, 1972): exact, without hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminar.llm.arrow_text import slices, word_lists
from laminar.llm.grams import covered, joined, numbered, occurrences, owners, word_codes

TURNS, LEAST = 4, 6
RUN = "struct<start:long,length:long,period:long>"


def runs_of(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, length, period`` of the maximal runs of all texts (``start`` counts in ``codes``), by start, then period."""
    size = len(codes)
    owner, ends = owners(offsets), np.repeat(offsets[1:], np.diff(offsets))
    long = np.repeat(np.diff(offsets), np.diff(offsets))
    rank, at = codes, np.flatnonzero(long >= LEAST)
    found = []
    lag = 1
    while len(at):
        k = 2 * lag
        at, keys = joined(rank, lag, rank, at[long[at] >= TURNS * lag], ends, k)
        placed, number, follows = occurrences(keys, at, owner)
        first = np.flatnonzero(follows)
        gap = placed[first + 1] - placed[first]
        near = (gap >= lag) & (gap < k)
        found.append(_extended(placed[first[near]], gap[near], k, size))
        rank = numbered(size, placed, number, follows)
        at = np.flatnonzero(rank >= 0)
        lag = k
    start, length, period = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 3
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _extended(place: np.ndarray, lag: np.ndarray, k: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of ``k`` words followed along their diagonals: the stretches that are runs."""
    place, lag = (x[np.lexsort((place, lag))] for x in (place, lag))
    head = np.ones(len(place), dtype=bool)
    head[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + 1)  # others are covered by the seed before
    last = np.flatnonzero(np.concatenate([head[1:], np.ones(min(len(head), 1), dtype=bool)]))
    start, period = place[head], lag[head]
    length = place[last] - start + k + period
    whole = length >= np.maximum(LEAST, TURNS * period)
    return start[whole], length[whole], period[whole]


def _batch(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Words, runs and collapsed text of each text."""
    flat, offsets = word_lists(pc.fill_null(texts, ""))
    start, length, period = runs_of(word_codes(flat), offsets)
    gone = covered(len(flat), start + period, start + length)
    of = np.searchsorted(offsets, start, side="right") - 1
    fields = [pa.array(x, type=pa.int64()) for x in (start - offsets[of], length, period)]
    per_text = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))])
    runs = pa.ListArray.from_arrays(pa.array(per_text, type=pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    left = np.concatenate([[0], np.cumsum(~gone)])[offsets]
    rest = pa.ListArray.from_arrays(pa.array(left, type=pa.int32()), flat.filter(pa.array(~gone)) if gone.any() else flat)
    return pa.array(np.diff(offsets), type=pa.int64()), runs, pc.binary_join(rest, " ")


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 4 << 20) -> DataFrame:
    """One row per row of ``docs``: ``(id_col, n_words, runs, collapsed)``.

    Words stand between ASCII white space and are numbered from 0. ``runs`` lists every maximal stretch of words with smallest
    period ``period`` and a length of at least six words and four periods, by start, then period. ``collapsed`` is the text, its
    words joined by one space, without the words that stand in a run after its first period.

    A null text and one without words have no words, no runs and an empty ``collapsed``. Rows with a null id and rows that
    repeat an id are rows like others; other columns are ignored; an empty table gives no rows. A text is held whole by
    the task that reads it, about fifty bytes a word, whatever its runs.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), slice_bytes):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *_batch(batch.column(1).slice(a, b - a))], names=[id_col, "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, n_words long, runs array<{RUN}>, collapsed string")


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` with all its columns, texts that hold runs collapsed (see ``find_runs``); others stay as they are, null included."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(place), slice_bytes):
                part = batch.slice(a, b - a)
                texts = part.column(place)
                _, runs, collapsed = _batch(texts)
                columns = part.columns
                columns[place] = pc.if_else(pc.greater(pc.list_value_length(runs), 0), collapsed, texts)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
