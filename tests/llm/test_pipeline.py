from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
from laminar.llm.simhash_dedup import simhash_groups
from laminar.storage import stage

from .test_op8_lines import brute as brute_lines
from .test_similar_documents import _shingles

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, function in corpus_pipeline.STAGES[:-1]:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(function(spark, docs, SF), name)
        assert out.columns == docs.columns
        after = [(r["doc_id"], r["text"]) for r in out.collect()]
        kept[name] = (before, after)
        docs = out
    before, after = kept["quality"]
    assert set(after) <= set(before)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [d for d, _ in before if labels.get(d) == 1]
    assert sum(d in {a for a, _ in after} for d in good) > 0.95 * len(good)
    before, after = kept["lines"]
    want = brute_lines(before)
    want = {d: t for (d, was), t in want.items() if t == was or (t or "").strip(" \t\n\r\x0b\x0c")}
    got = dict(after)
    assert all(len(got[d].split("\n")) >= len(t.split("\n")) for d, t in want.items() if t is not None)  # nothing goes without a near line
    assert sum(got[d] == t for d, t in want.items()) >= 0.99 * len(want)
    before, after = kept["near_duplicates"]
    sets, root = {d: _shingles(t or "") for d, t in before}, {d: d for d, _ in before}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[max(top(a), top(b))] = min(top(a), top(b))
    assert {d for d, _ in after} == {top(d) for d in sets}
    before, after = kept["mix"]
    copies = defaultdict(int)
    for d, _ in after:
        copies[d] += 1
    assert set(copies) <= {d for d, _ in before} and max(copies.values()) <= 3
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    words = sum(len(t.split()) for _, t in after)
    assert sum(r["length"] for r in packed) == words


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and simhash_groups(spark.read.parquet(f"{SF}/documents.parquet")).count() == 200


def test_stages_take_odd_rows(spark, make_docs):
    """Nulls, empty, blank, repeated and long texts, clashing columns, empty tables: no stage stops, all keep the columns."""
    from .conftest import ODD

    for docs in (make_docs(ODD), make_docs(ODD).limit(0)):
        for name, function in corpus_pipeline.STAGES[:-1]:
            after = stage(function(spark, docs, SF), f"odd{name}")
            assert after.columns == docs.columns
            ids = {r["doc_id"] for r in after.select("doc_id").collect()}
            assert ids <= {r["doc_id"] for r in docs.select("doc_id").collect()}
            if name == "near_duplicates":
                assert after.count() == after.dropDuplicates(["doc_id"]).count()
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        words = sum(len((r["text"] or "").split()) for r in docs.select("text").collect())
        assert sum(r["length"] for r in packed.select("length").collect()) == words
