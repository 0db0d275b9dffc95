"""Operator 13: counts by definition, one test a rule, odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from laminar.llm.line_quality import COUNTS, RULES, _batch, clean_documents, judge_documents, judge_lines

from .conftest import ODD


def counts_by_definition(text: str) -> dict:
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    inside = {j for i, g in enumerate(windows) if often[g] > 1 for j in range(i, i + 5)}
    worded = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(worded) - len(set(worded)),
        "n_repeat_words": len(inside),
        "n_lines": len(worded),
    }


def test_counts_follow_the_definition():
    rng = random.Random(5)
    texts = [""] + ["".join(rng.choice(["a", "b", "ä", "語", "#", "|", " ", " ", " ", "\n", "\t", "\x0b", " "]) for _ in range(rng.randrange(200))) for _ in range(600)]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(40))) for _ in range(300)]
    made = _batch(pa.array([*texts, None]))
    for k, text in enumerate([*texts, ""]):
        for name, want in counts_by_definition(text).items():
            assert made[name][k].as_py() == want, (name, text)


@pytest.mark.parametrize(
    "line, rule",
    [
        ("Home | News | Sport | About us", "navigation"),
        ("start » shop » shoes » red", "navigation"),
        ("BUY!! NOW!! CHEAP!!", "punctuation"),
        ("Our products and prices", "punctuation"),
        ("All rights reserved.", "boilerplate"),
        ("This work is LICENSED UNDER the GNU General Public License, version 3.", "boilerplate"),
        ("Tous droits réservés.", "boilerplate"),
        ("A plain sentence that ends well.", None),
        ('She said: "It is late!"', None),
        ("Short title", None),
        ("The table a | b shows a pipe once in a long line of running words that goes on.", None),
        (" ".join(["word"] * 40) + " click here " + " ".join(["word"] * 40) + ".", None),
        (" ".join(["word"] * 60), None),
        ("", None),
        (" \t ", None),
    ],
)
def test_line_rules(line, rule):
    assert judge_lines(pa.array([line]))[0].tolist() == [0 if rule is None else 1 + RULES.index(rule)]


PROSE = "The river runs past the old mill and on to the sea.\nNobody had crossed it since the bridge fell in the storm."


def test_documents_that_lose_too_much_go(make_docs):
    menu = "\n".join(f"Home{k} | News{k} | Sport{k} | About{k} us" for k in range(3))
    docs = make_docs([(1, PROSE), (2, PROSE + "\nAll rights reserved."), (3, menu + "\nA line of prose follows here."), (4, "Too few words."), (5, "one two three four five six. " * 9), *[(r[0] and 10 + r[0], r[1]) for r in ODD]])
    found = judge_documents(docs)
    assert found.count() == docs.count()
    by = {r["doc_id"]: r for r in found.collect()}
    assert [by[k]["kept"] for k in range(1, 6)] == [True, True, False, False, False]
    assert by[2]["cleaned"] == PROSE and by[2]["n_boilerplate"] == 1 and by[3]["n_navigation"] == 3
    assert not by[3]["base_failed"] and by[4]["base_failed"] and by[5]["base_failed"]
    for k in (11, 12, 13):
        assert by[k]["n_words"] == 0 and by[k]["base_failed"] and not by[k]["kept"]
    assert by[11]["cleaned"] is None and by[12]["cleaned"] == ""
    assert by[16]["n_repeat_words"] == 30000
    rows = clean_documents(docs)
    assert rows.columns == docs.columns
    assert {(r["doc_id"], r["text"]) for r in rows.collect()} == {(1, PROSE), (2, PROSE)}
    assert judge_documents(docs.limit(0)).count() == 0 and clean_documents(docs.limit(0)).count() == 0


def test_slices_do_not_matter(make_docs):
    docs = make_docs([(k, PROSE * (k % 4) + "\nmenu | a | b | c\n" * (k % 3)) for k in range(30)])
    one, two = (sorted(map(str, judge_documents(docs, slice_bytes=s).select("doc_id", *COUNTS, "kept").collect())) for s in (1, 1 << 20))
    assert one == two


def test_good_documents_stay(spark, corpus):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").groupBy("doc_id").agg({"quality": "max"}).withColumnRenamed("max(quality)", "q")
    judged = judge_documents(corpus).join(labels, "doc_id").where("NOT base_failed")
    n = {(r["q"], r["kept"]): r["count"] for r in judged.groupBy("q", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.01 * n[(1, True)]
    assert n.get((0, True), 0) <= 0.05 * n[(0, False)]
