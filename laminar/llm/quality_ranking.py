"""Operator 1: quality scores learned from preference pairs (Bradley-Terry), thresholded by score quantile.

A pair (better, worse) contributes the logistic loss of the difference of their feature vectors; the
weights that minimise it give every text a score of its own. The threshold is the quantile of the
training scores that separates the two labels best, and scores are put through a logistic function
centred on it. Features come from the whole text only; labels, language, source and ids are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminar.llm.arrow_text import per_list_sum, slices, word_lists

SAMPLE_PER_LABEL = 8000
PAIRS = 120_000

_CLASSES = ("upper", "lower", "digit", "space", "newline", "stop", "bang", "pipe", "symbol", "quote", "other", "high")


def _byte_classes() -> np.ndarray:
    table = np.full(256, _CLASSES.index("other"), dtype=np.uint8)
    for name, chars in (("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("lower", "abcdefghijklmnopqrstuvwxyz"), ("digit", "0123456789"), ("space", " \t"), ("newline", "\n\r"), ("stop", ".,;:?"), ("bang", "!"), ("pipe", "|"), ("symbol", "#$%&*@^~+=<>_\\/"), ("quote", "\"'()[]{}-`")):
        table[[ord(c) for c in chars]] = _CLASSES.index(name)
    table[128:] = _CLASSES.index("high")
    return table


_TABLE = _byte_classes()
N_FEATURES = 2 * (len(_CLASSES) - 1) + 9


def features(texts: pa.Array) -> np.ndarray:
    """One row of numbers per text: shares of byte classes, word lengths, repetition of words and lines."""
    rows = len(texts)
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    bounds = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[: bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    first = np.frombuffer(texts.buffers()[1], dtype=np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset] if rows else 0
    raw = np.frombuffer(data, dtype=np.uint8)[first : first + bounds[-1]] if data is not None else raw
    kinds = _TABLE[raw]
    size = np.maximum(np.diff(bounds), 1)
    share = np.stack([per_list_sum(kinds == k, bounds) / size for k in range(len(_CLASSES))], axis=1)
    share = np.delete(share, _CLASSES.index("lower"), axis=1)

    flat, offsets = word_lists(texts)
    counts = np.maximum(np.diff(offsets), 1)
    word_bytes = np.asarray(pc.binary_length(flat), dtype=np.int64)
    mean_word = per_list_sum(word_bytes, offsets) / counts
    long_words = per_list_sum(word_bytes > 18, offsets) / counts
    coded = flat.dictionary_encode().indices.to_numpy() if len(flat) else np.zeros(0, np.int64)
    again = np.zeros(len(flat), dtype=bool)
    again[1:] = coded[1:] == coded[:-1]
    repeats = per_list_sum(again, offsets) / counts
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    width = int(coded.max(initial=0)) + 1
    keys, held = np.unique(owner * width + coded, return_counts=True)
    of = keys // width
    distinct = np.bincount(of, minlength=rows)
    top = np.zeros(rows)
    np.maximum.at(top, of, held)
    lines = share[:, _CLASSES.index("newline") - 1] * size + 1
    extra = np.stack(
        [mean_word, long_words, repeats, np.sqrt(repeats), np.log1p(np.diff(offsets)), np.log((distinct + 1) / (counts + 1)), top / counts, np.log1p(counts / lines), (np.diff(offsets) == 0).astype(float)],
        axis=1,
    )
    return np.concatenate([share, np.sqrt(share), extra], axis=1)


@dataclass
class Ranker:
    """Centre and scale of the features, weights, threshold on the raw score, and its scale."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.threshold) / self.spread, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1.0, seed: int = 3, steps: int = 12) -> Ranker:
    """Bradley-Terry weights by Newton steps on ``pairs`` sampled preferences, and the best score quantile.

    With one label only, or none, every text gets that label (1 where there is none).
    """
    if not len(x) or y.min() == y.max():
        side = 1.0 if not len(x) or y[0] == 1 else -1.0
        return Ranker(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), -side, 1.0)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    better, worse = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[rng.choice(better, pairs)] - z[rng.choice(worse, pairs)]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (p - 1) + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    raw = z @ w
    order = np.sort(raw)
    # quantiles of the training scores; the one with the best balanced accuracy, in the middle of its run
    cuts = np.unique(np.quantile(order, np.linspace(0.0005, 0.9995, 2000)))
    good, bad = np.sort(raw[y == 1]), np.sort(raw[y == 0])
    right = (1 - np.searchsorted(good, cuts, "left") / len(good)) / 2 + np.searchsorted(bad, cuts, "left") / len(bad) / 2
    best = cuts[right >= right.max() - 1e-12]
    threshold = float((best[0] + best[-1]) / 2)
    return Ranker(mean, scale, w, threshold, float(max(np.std(raw), 1e-6) / 4))


def held_out(id_col: str = "doc_id"):
    """True for rows whose crc32 of the id as text is 1 modulo 3 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_PER_LABEL) -> Ranker:
    """Fit on labelled rows that are not held out.

    At most ``sample`` ids per label, those of smallest hash, are the bounded training sample; a larger
    table changes which rows they are, not how many. Ids with several labels count as their lowest;
    null ids and labels are ignored.
    """
    one = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = None
    for value in (0, 1):
        part = one.where(F.col("quality") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = part if picked is None else picked.union(part)
    chosen = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # 2 * sample rows at most
    made = chosen.mapInArrow(_feature_batches, "quality int, x array<double>").orderBy(F.xxhash64("x"), "quality").limit(4 * sample)
    rows = made.collect()
    x = np.array([r["x"] for r in rows], dtype=np.float64).reshape(-1, N_FEATURES)
    order = np.lexsort(x.T)  # the order of collection does not matter
    return fit(x[order], np.array([r["quality"] for r in rows])[order])


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "")
        for a, b in slices(texts, 4 << 20):
            x = features(texts.slice(a, b - a))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(2).slice(a, b - a).cast(pa.int32()), lists], names=["quality", "x"])


def score_documents(docs: DataFrame, model: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, score, predicted)`` for each row of ``docs``; a null text is scored as an empty one.

    ``score`` is between 0 and 1 and ``predicted`` is 1 from 0.5 on. Repeated rows, null ids and ties
    give a row each; an empty table gives none. Other columns are not read.
    """
    narrow = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    id_type = narrow.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), 4 << 20):
                score = model.score(features(batch.column(1).slice(a, b - a)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"]
                )

    return narrow.mapInArrow(run, f"`{id_col}` {id_type}, score double, predicted int")


def filter_by_quality(docs: DataFrame, model: Ranker, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that the model accepts, all columns as they are."""
    names = docs.columns
    spot = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(spot), "")
            for a, b in slices(texts, 4 << 20):
                keep = model.score(features(texts.slice(a, b - a))) >= 0.5
                yield batch.slice(a, b - a).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
