from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from laminar.llm.arrow_text import pieces
from laminar.llm.queries import op4_token_counts
from laminar.llm.token_counts import _count, count_tokens

from .conftest import ODD

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

def _whole(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    tok.no_truncation()
    tok.no_padding()
    return [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library_on_whole_texts(spark, corpus):
    rows = corpus.select("doc_id", "text").collect()
    want = dict(zip([r[0] for r in rows], _whole([r[1] for r in rows]), strict=True))
    got = op4_token_counts(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_tokens"] == want[r["doc_id"]]
        assert r["over_limit"] == (want[r["doc_id"]] > 2048)
    sizes = {r[0]: len(r[1].encode()) for r in rows}
    assert all(r["n_bytes"] == sizes[r["doc_id"]] for r in got)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"aB1é'ßΣς \t\n\r\x0b\x1cć  <|>!?,.ﬁﬀ中文🙂", "<|endoftext|>", "'s", "'ll"]), max_size=60).map("".join))
def test_white_space_is_a_safe_boundary(text):
    assert _count(pa.array([text]), TOKENIZER)[0] == _whole([text])[0]


def test_special_strings_and_pieces():
    text = "a <|endoftext|> b<|startoftext|>c " * 5
    assert _count(pa.array([text]), TOKENIZER)[0] == _whole([text])[0]
    long = "ab cde  f\n" * 500
    assert sum(_count(pa.array([p]), TOKENIZER)[0] for p in pieces(long, 37)) == _whole([long])[0]


def test_odd_rows_and_small_slices(make_docs):
    docs = make_docs(ODD)
    got = count_tokens(docs, TOKENIZER, slice_bytes=1000).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["n_tokens"] == 0 and by[1][0]["n_bytes"] == 0
    assert by[6][0]["n_tokens"] == 30000 and by[6][0]["over_limit"]
    assert by[7][0]["n_tokens"] == _whole(["x" * 200000])[0]
    assert count_tokens(docs.limit(0), TOKENIZER).count() == 0
