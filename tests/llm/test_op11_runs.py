"""Operator 11 against the definition of a run, over every lag of small texts."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from laminar.llm.periodic_runs import _batch, collapse_runs, find_runs
from laminar.llm.queries import op11_periodic_runs, with_planted_runs

from .conftest import ODD


def runs_by_definition(w: list[str]) -> list[tuple[int, int, int]]:
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            part = w[s : i + q]
            least = next(p for p in range(1, q + 1) if all(part[x] == part[x + p] for x in range(len(part) - p)))
            if least == q and len(part) >= max(6, 4 * q):
                out.append((s, len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(rng: random.Random, letters: int, n: int, times: int) -> list[str]:
    w = [rng.choice("abcdefghijklmnopqrstuvwxyzABCDE"[:letters]) for _ in range(n)]
    for _ in range(times):
        a = rng.randrange(n)
        p, end = rng.randrange(1, max(2, (n - a) // 3 + 1)), rng.randrange(a, n + 1)
        for i in range(a, end):
            w[i] = w[a + (i - a) % p]
    return w


def test_runs_and_collapsed_texts_follow_the_definition():
    rng = random.Random(3)
    texts = [planted(rng, rng.choice([1, 2, 2, 3, 5, 30]), rng.choice([1, 5, 6, 7, 20, 60, 100]), rng.randrange(4)) for _ in range(1500)]
    n, runs, collapsed = _batch(pa.array([" ".join(w) for w in texts]))
    found = 0
    for w, size, r, rest in zip(texts, n.to_pylist(), runs.to_pylist(), collapsed.to_pylist(), strict=True):
        want = runs_by_definition(w)
        found += len(want)
        assert size == len(w)
        assert [(x["start"], x["length"], x["period"]) for x in r] == want
        gone = {i for s, length, q in want for i in range(s + q, s + length)}
        assert rest == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert found > 300


def test_long_texts_of_one_word_or_one_long_period():
    texts = ["word " * 300_000, " ".join(str(i % 5000) for i in range(100_000))]
    _, runs, collapsed = _batch(pa.array(texts))
    assert runs.to_pylist() == [[{"start": 0, "length": 300_000, "period": 1}], [{"start": 0, "length": 100_000, "period": 5000}]]
    assert collapsed.to_pylist() == ["word", " ".join(map(str, range(5000)))]


def test_odd_rows(make_docs):
    docs = make_docs([*ODD, (8, "a b " * 4 + "\tc\x0bd é é é é é é")])
    got = find_runs(docs)
    assert got.count() == docs.count()
    by = {r["doc_id"]: r for r in got.collect()}
    for k in (1, 2, 3):
        assert (by[k]["n_words"], by[k]["runs"], by[k]["collapsed"]) == (0, [], "")
    assert by[8]["collapsed"] == "a b c d é"
    assert [tuple(r) for r in by[6]["runs"]] == [(0, 30000, 1)]
    assert by[None]["collapsed"] == "null id here with some words"
    rows = collapse_runs(docs)
    assert rows.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert texts[1] is None and texts[3] == "   \n\t " and texts[6] == "word" and texts[7] == "x" * 200000
    assert find_runs(docs.limit(0)).count() == 0


def test_planting_leaves_null_ids_and_empty_texts(make_docs):
    docs = make_docs([(k, None if k % 3 == 0 else " " if k % 3 == 1 else "one two three four five") for k in range(60)] + [(None, "a b c")])
    assert with_planted_runs(docs).count() == 61
    assert with_planted_runs(docs).where("doc_id IS NULL AND text = 'a b c'").count() == 1


def test_query_has_a_row_per_document(spark):
    sf = "/root/testdata/sf0.001"
    out = op11_periodic_runs(spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    some = out.where("n_runs > 0")
    assert some.count() and some.where((F.col("exponent_milli") < 4000) | (F.col("length") < 6)).count() == 0


@pytest.mark.parametrize("slice_bytes", [1, 100, 1 << 20])
def test_slices_do_not_matter(make_docs, slice_bytes):
    docs = make_docs([(k, "x y " * k + "z") for k in range(40)])
    assert sorted(map(str, find_runs(docs, slice_bytes=slice_bytes).collect())) == sorted(map(str, find_runs(docs).collect()))
