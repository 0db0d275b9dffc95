from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from laminar.llm.quality_ranking import N_FEATURES, features, filter_by_quality, fit, score_documents, train
from laminar.llm.queries import op1_quality_ranking

from .conftest import ODD


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in op1_quality_ranking(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    test = [(labels[d], r["predicted"], r["score"]) for d, r in got.items() if d in labels and r["held_out"]]
    bad = [p for y, p, _ in test if y == 0]
    good = [p for y, p, _ in test if y == 1]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.15
    auc = np.mean([a > b for y, _, a in test if y == 1 for z, _, b in test if z == 0])
    assert auc > 0.97


def test_batches_do_not_matter():
    texts = ["One line.\nTwo lines here", "", "A!! B!! C!!", "é é é | ñ", "x " * 500]
    whole = features(pa.array(texts))
    assert whole.shape == (5, N_FEATURES) and np.isfinite(whole).all()
    for k, t in enumerate(texts):
        assert np.allclose(whole[k], features(pa.array([t]))[0])
        assert np.allclose(whole[k:], features(pa.array(texts).slice(k)))


def test_one_label_or_none(spark, make_docs):
    docs = make_docs(ODD)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["predicted"] for r in score_documents(docs, train(docs, none)).collect()} == {1}
    bad = spark.createDataFrame([(k, 0) for k in range(3, 8)], "doc_id long, quality int")
    assert {r["predicted"] for r in score_documents(docs, train(docs, bad)).collect()} == {0}


def test_odd_rows(spark, make_docs):
    docs = make_docs(ODD)
    labels = spark.createDataFrame([(4, 1), (6, 0), (4, 1), (5, None), (None, 0)], "doc_id long, quality int")
    model = train(docs, labels)
    got = score_documents(docs, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    kept = filter_by_quality(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)
    assert score_documents(docs.limit(0), model).count() == 0


def test_ranking_learns_pairs():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, N_FEATURES))
    y = (x[:, 3] - x[:, 5] > 0.3).astype(int)
    model = fit(x, y, pairs=4000)
    assert np.mean((model.score(x) >= 0.5) == y) > 0.95


def test_fit_is_the_minimum_of_the_loss_and_the_threshold_the_best_quantile():
    """Loss, gradient and balanced accuracy written out pair by pair and row by row."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((120, N_FEATURES))
    y = (x[:, 1] + 0.5 * x[:, 2] + rng.standard_normal(120) > 0).astype(int)
    model = fit(x, y, pairs=900, ridge=1.0, seed=3)
    z = np.clip((x - x.mean(0)) / np.maximum(x.std(0), 1e-6), -8, 8)
    draw = np.random.default_rng(3)
    better, worse = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    pairs = list(zip(draw.choice(better, 900), draw.choice(worse, 900), strict=True))

    def loss(w):
        return sum(np.log1p(np.exp(-(z[a] - z[b]) @ w)) for a, b in pairs) + 0.5 * w @ w

    gradient = model.weights.copy()
    for a, b in pairs:
        d = z[a] - z[b]
        gradient -= d / (1 + np.exp(d @ model.weights))
    assert np.abs(gradient).max() < 1e-6
    least = loss(model.weights)
    assert all(loss(model.weights + 1e-2 * rng.standard_normal(N_FEATURES)) > least for _ in range(20))
    raw = z @ model.weights
    right = lambda cut: (np.mean([r >= cut for r in raw[y == 1]]) + np.mean([r < cut for r in raw[y == 0]])) / 2
    cuts = np.unique(np.quantile(np.sort(raw), np.linspace(0.0005, 0.9995, 2000)))
    score = np.array([right(c) for c in cuts])
    best = cuts[score >= score.max() - 1e-12]
    assert best[0] <= model.threshold <= best[-1]
    assert ((model.score(x) >= 0.5) == (raw >= model.threshold)).all()
