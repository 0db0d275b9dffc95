from __future__ import annotations

import hashlib
import math
import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from laminar.llm.private_data import base_spans, find_private_data, sanitise
from laminar.llm.queries import op9_private_data

from .conftest import ODD

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        n = int(c) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute(text):
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text or ""):
            d = re.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(d) <= 19 and _luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if fits:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def _text(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_query_against_brute_force(spark, corpus):
    rows = {r[0]: r[1] for r in corpus.select("doc_id", "text").collect()}
    got = op9_private_data(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(rows)
    found = 0
    for r in got:
        want = brute(rows[r["doc_id"]])
        found += len(want)
        assert r["base_sha256"] == hashlib.sha256(_text(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(w[0] == k for w in want) for k in KINDS]
        assert set(_text(want).split(",")) <= set(r["spans"].split(",")) | {""}
        if not want:
            assert r["spans"] == ""
    assert found > 50


TRICKY = ["a@b.c..d@e.f a@b_c@d.e", "1.2.3.4.5.6.7.8 0001.2.3.256 1..2.3.4.5", "4111 1111 1111 1111 and 4111-1111-1111-1112 41111111111111111111", "+1 (555) 123-4567. +12 +123456789 +1234567890123456", "🙂🙂 x@y.zz é 10.0.0.1", "0" * 4000 + "." + "1." * 3000, "a." * 5000 + "@" + "b." * 5000 + "c", "1 " * 6000, "00000000000000000000300.1.1.1", "@@a@b", "+" * 500 + "1" * 20]


def test_tricky_texts(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TRICKY)], "doc_id long, text string")
    for r in base_spans(docs).collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"]] == brute(TRICKY[r["doc_id"]]), TRICKY[r["doc_id"]][:60]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB1234567890.@+-() _%é", max_size=40), min_size=30, max_size=60))
def test_random_texts(spark, texts):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in base_spans(docs).collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"]] == brute(texts[r["doc_id"]]), texts[r["doc_id"]]


def _telling():
    rows = [(k, f"filler number words about weather {'abcdefghij'[k % 10]} and sport") for k in range(200)]
    for k, w in enumerate(("early", "later", "often", "never", "again")):
        rows.append((300 + k, f"the {w} report says Zanzibarov wrote from zan@corp.org about weather {w}"))
    return rows


def test_terms_that_disclose_a_value(spark):
    rows = _telling()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in find_private_data(docs).collect()}
    for d, t in rows:
        terms = {t[s["start"] : s["end"]] for s in got[d]["added"]}
        if d < 300:
            assert not terms
        else:
            assert "Zanzibarov" in terms and "weather" not in terms
    clean = {r["doc_id"]: r["text"] for r in sanitise(docs).collect()}
    assert all(clean[d] == t for d, t in rows if d < 300)
    assert "Zanzibarov" not in clean[300] and "zan@corp" not in clean[300] and "[email]" in clean[300] and "weather" in clean[300]


def added_by_definition(rows, threshold=0.8, contexts=3):
    """Telling terms from sets of texts, value by term."""
    terms = lambda t: {x.lower() for x in re.findall(r"[^\W\d_]+", t)}
    n = len(rows)
    df, mentions = {}, {}
    for _, t in rows:
        for x in terms(t):
            df[x] = df.get(x, 0) + 1
        for kind, a, b in brute(t):
            mentions.setdefault(t[a:b], []).append(t)
    telling = set()
    for texts in mentions.values():
        n_e, different = len(texts), set(texts)
        if len(different) < contexts or n_e == n:
            continue
        for x in set().union(*map(terms, different)):
            joint = sum(x in terms(t) for t in texts)
            if sum(x in terms(t) for t in different) >= contexts and math.log(joint / df[x] / (n_e / n)) / -math.log(n_e / n) >= threshold:
                telling.add(x)
    out = {}
    for d, t in rows:
        base = brute(t)
        out[d] = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", t) if m[0].lower() in telling and not any(a < m.end() and m.start() < b for _, a, b in base)]
    return out


def test_added_spans_follow_the_definition(spark):
    rng = random.Random(8)
    people = [f"person{chr(97 + k)}" for k in range(12)]
    common = "the of and report weather sport city river market school".split()
    rows = []
    for k in range(260):
        words = rng.choices(common, k=6) + rng.sample([f"rare{chr(97 + j)}{chr(97 + i)}" for j in range(9) for i in range(9)], 2)
        if k % 3 == 0:
            p = rng.choice(people)
            words += [f"{p}@mail.org"] + ([p.upper()] if rng.random() < 0.8 else []) + ([f"nick{p}"] if rng.random() < 0.7 else [])
        if k % 11 == 0:
            words += [rng.choice(people), "10.0.0.1"]
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
    rows += [(300 + k, rows[3 * k][1]) for k in range(20)]  # copies
    page = " ".join(f"u{chr(97 + a)}{chr(97 + b)}@dir.net Name{chr(97 + a)}{chr(97 + b)}" for a in range(8) for b in range(8))
    rows += [(400 + k, f"{page} edition {w}") for k, w in enumerate(("first", "second", "third"))]  # many values and terms of the same texts
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["added"]] for r in find_private_data(docs).collect()}
    want = added_by_definition(rows)
    assert got == want
    assert sum(map(len, want.values())) > 150


def test_spans_in_the_given_documents(spark, corpus):
    rows = [(r[0], r[1]) for r in corpus.select("doc_id", "text").collect()]
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["added"]] for r in find_private_data(corpus).collect()}
    assert got == added_by_definition(rows)


def test_copies_alone_disclose_nothing(spark):
    rows = [(k, "plain words only") for k in range(50)] + [(100 + k, "Unusualword near me@corp.org here") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(not r["added"] for r in find_private_data(docs).collect())


def test_odd_rows(make_docs):
    docs = make_docs([*ODD, (8, "mail a@b.cc now"), (8, "mail a@b.cc now")])
    got = find_private_data(docs).collect()
    assert len(got) == len(ODD) + 2
    assert [len(r["spans"]) for r in got if r["doc_id"] == 8] == [1, 1]
    out = sanitise(docs)
    assert out.columns == docs.columns and out.count() == len(ODD) + 2
    assert find_private_data(docs.limit(0)).count() == 0
