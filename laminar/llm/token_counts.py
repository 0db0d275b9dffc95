"""Operator 4: token counts of whole texts, lengths only.

Each Arrow batch is cut into slices balanced by bytes, and long texts into pieces at white space. White
space is a safe boundary for this kind of vocabulary (no merge, no added token and no step of the
normaliser reaches across it), so a text has as many tokens as its words together. Words that repeat are
encoded once: the distinct words of a slice go through the library's batch encoder, and their lengths are
kept in a bounded memo of the Python worker.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminar.llm.arrow_text import per_list_sum, pieces, slices, word_lists

_LOADED: dict = {}
_MEMO_WORDS = 400_000
_MEMO_WORD_BYTES = 48


def _tokenizer(path: str):
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _LOADED.clear()
        _LOADED[path] = (tok, {})
    return _LOADED[path]


def word_lengths(words: list[str], path: str, batch_bytes: int = 1 << 20) -> np.ndarray:
    """Tokens of each word, by the library's batch encoder, in batches of about ``batch_bytes``."""
    tok, memo = _tokenizer(path)
    out = np.fromiter((memo.get(w, -1) for w in words), dtype=np.int64, count=len(words))
    todo = np.flatnonzero(out < 0)
    at = 0
    while at < len(todo):
        batch, held = [], 0
        while at + len(batch) < len(todo) and (not batch or held < batch_bytes):
            batch.append(words[todo[at + len(batch)]])
            held += len(batch[-1])
        got = [len(e) for e in tok.encode_batch_fast(batch, add_special_tokens=False)]
        out[todo[at : at + len(batch)]] = got
        if len(memo) + len(batch) > _MEMO_WORDS:
            memo.clear()
        memo.update((w, n) for w, n in zip(batch, got, strict=True) if len(w) <= _MEMO_WORD_BYTES)
        at += len(batch)
    return out


def _count(texts: pa.Array, path: str) -> np.ndarray:
    flat, offsets = word_lists(texts)
    if not len(flat):
        return np.zeros(len(offsets) - 1, dtype=np.int64)
    coded = flat.dictionary_encode()
    lengths = word_lengths(coded.dictionary.to_pylist(), path)
    return per_list_sum(lengths[coded.indices.to_numpy()], offsets)


def count_tokens(
    docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 4 << 20
) -> DataFrame:
    """Rows ``(id_col, n_bytes, n_tokens, over_limit)``, one per row of ``docs``, in any order.

    A null text counts as empty (0 bytes, 0 tokens); repeated rows and null ids give a row each; other
    columns of ``docs`` are not read. ``tokenizer_path`` is a ``.json`` file of the tokenizers library,
    present at the same place on every machine. No special tokens are added; the vocabulary's special
    strings inside a text are treated as the library does by default. No truncation, no padding.
    """
    narrow = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    id_type = narrow.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            n_bytes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            n_tokens = np.zeros(len(texts), dtype=np.int64)
            for a, b in slices(texts, slice_bytes):
                if b - a == 1 and n_bytes[a] > slice_bytes:
                    parts = pieces(texts[a].as_py(), slice_bytes)
                    n_tokens[a] = sum(int(_count(pa.array([p], pa.string()), tokenizer_path)[0]) for p in parts)
                else:
                    n_tokens[a:b] = _count(texts.slice(a, b - a), tokenizer_path)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return narrow.mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
