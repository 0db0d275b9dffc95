"""Operator 13: line-first cleaning. Rules judge single lines, failing lines go, then documents that lose too much go.

A line that holds a word fails by the first of these rules that fits:

* navigation: three or more separators (``| » › • ·``), one at least for every three words: menus and link lists;
* punctuation: loud marks (``! # * $ % & < > = ~ ^ _``, runs of question marks aside) at least half as many as words and three at
  least, or three to twenty words that end without a closing mark, a colon or a comma (also before quotes and brackets);
* boilerplate: a stock phrase of sites, licences and consent boxes in a line of at most thirty words.

A document is kept when half of its word characters at least stand in lines that stay, and the counts over the whole text
pass (ten words or more, at most a fifth of the words in five-word windows that repeat).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminar.llm.arrow_text import per_list_sum, slices, word_lists
from laminar.llm.grams import covered, joined, numbered, occurrences, owners, word_codes

SEPARATORS = r"[|»›•·]"
LOUD = r"[!#*$%&<>=~^_]"
CLOSED = r"[.!?…。！？:;,][\"'”’»)\]]*[ \x09-\x0D]*$"
# fixed stock phrases, in lower case
PHRASES = (
    r"(?i)(all rights reserved|privacy policy|cookie policy|terms of (use|service)|accept (all )?cookies|enable javascript|click here|sign up|log in|subscribe (now|to)|"
    r"licensed under|spdx-license-identifier|permission is hereby granted|lorem ipsum|alle rechte vorbehalten|datenschutzerkl|impressum|"
    r"tous droits r.serv.s|mentions l.gales|politique de confidentialit|todos los derechos reservados|pol.tica de privacidad|aviso legal)"
)
BOILERPLATE_WORDS, OPEN_LEAST, OPEN_MOST = 30, 3, 20
LEAST_WORDS, WINDOW, REPEATED_PERCENT, KEPT_PERCENT = 10, 5, 20, 50
_SPACE, _SYMBOL = (np.array([chr(b) in s for b in range(256)]) for s in (" \t\n\v\f\r", "#*$%&|<>"))
RULES = ("navigation", "punctuation", "boilerplate")


def repeated_words(codes: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per text, how many words stand in windows of ``window`` words (4 to 8) that occur twice or more in it."""
    size, owner, ends = len(codes), owners(offsets), np.repeat(offsets[1:], np.diff(offsets))
    at, rank = np.arange(size), codes
    for gap, length in ((1, 2), (2, 4), (window - 4, window)):
        at, keys = joined(rank, gap, rank, at, ends, length)
        rank = numbered(size, *occurrences(keys, at, owner))
        at = np.flatnonzero(rank >= 0)
    return per_list_sum(covered(size, at, at + window), offsets)


def _byte_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text: code points other than ASCII white space, and symbols."""
    whole = pa.concat_arrays([texts])
    offsets = np.frombuffer(whole.buffers()[1], dtype=np.int32)[whole.offset : whole.offset + len(whole) + 1].astype(np.int64)
    data = np.frombuffer(whole.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if whole.buffers()[2] else np.zeros(0, dtype=np.uint8)
    letters = ((data & 0xC0) != 0x80) & ~_SPACE[data]
    return per_list_sum(letters, offsets - offsets[0]), per_list_sum(_SYMBOL[data], offsets - offsets[0])


def judge_lines(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each line the number of the rule it fails (0: none; else its place in ``RULES`` from 1), and its words."""
    count = lambda pattern: pc.count_substring_regex(lines, pattern).to_numpy()
    words = np.diff(word_lists(lines)[1])
    separators, loud = count(SEPARATORS), count(LOUD)
    closed = pc.match_substring_regex(lines, CLOSED).to_numpy(zero_copy_only=False)
    stock = pc.match_substring_regex(lines, PHRASES).to_numpy(zero_copy_only=False) & (words <= BOILERPLATE_WORDS)
    navigation = (separators >= 3) & (3 * separators >= words)
    punctuation = ((loud >= 3) & (2 * loud >= words)) | ((words >= OPEN_LEAST) & (words <= OPEN_MOST) & ~closed)
    failed = np.select([words == 0, navigation, punctuation, stock], [0, 1, 2, 3], 0)
    return failed, words


def _batch(texts: pa.Array) -> dict[str, pa.Array]:
    texts_ = pc.fill_null(texts, "")
    flat, offsets = word_lists(texts_)
    chars, symbols = _byte_counts(texts_)
    split = pc.split_pattern(texts_, "\n")
    lines, at = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    failed, words = judge_lines(lines)
    # lines equal to an earlier one of the same text: all but one of each (text, line)
    worded = np.flatnonzero(words > 0)
    placed, number, follows = occurrences(word_codes(lines)[worded], worded, owners(at))
    again = np.zeros(len(lines), dtype=bool)
    again[placed[1:][follows[:-1]]] = True
    line_chars = _byte_counts(lines)[0]
    stays = failed == 0
    left = np.concatenate([[0], np.cumsum(stays)])[at]
    cleaned = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, type=pa.int32()), lines.filter(pa.array(stays))), "\n")
    made = {
        "n_words": np.diff(offsets),
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": per_list_sum(again, at),
        "n_repeat_words": repeated_words(word_codes(flat), offsets),
        "n_lines": per_list_sum(words > 0, at),
        **{f"n_{rule}": per_list_sum(failed == k, at) for k, rule in enumerate(RULES, 1)},
        "kept_chars": per_list_sum(np.where(stays, line_chars, 0), at),
    }
    return {**{k: pa.array(v, type=pa.int64()) for k, v in made.items()}, "cleaned": pc.if_else(pc.is_null(texts), pa.scalar(None, pa.string()), cleaned)}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", *(f"n_{r}" for r in RULES), "kept_chars")


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 4 << 20) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, the counts of ``COUNTS``, ``cleaned``, ``base_failed``, ``kept``.

    ``n_lines`` counts lines that hold a word, ``n_navigation``, ``n_punctuation`` and ``n_boilerplate`` those that fail by that rule,
    ``kept_chars`` the word characters of lines that stay. ``cleaned`` is the text without failing lines. A null text counts as
    empty (its ``cleaned`` is null); a text without words fails the base rules. Null and repeated ids are rows like others, other
    columns are ignored, an empty table gives no rows. A text is held whole by the task that reads it.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), slice_bytes):
                made = _batch(batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[made[c] for c in COUNTS], made["cleaned"]], names=[id_col, *COUNTS, "cleaned"])

    found = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, {', '.join(f'{c} long' for c in COUNTS)}, cleaned string")
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    kept = ~F.col("base_failed") & (100 * F.col("kept_chars") >= KEPT_PERCENT * F.col("word_chars"))
    return found.withColumn("base_failed", base).withColumn("kept", kept)


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; ``text_col`` without its failing lines."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(place), slice_bytes):
                part = batch.slice(a, b - a)
                made = _batch(part.column(place))
                n = {c: made[c].to_numpy() for c in COUNTS}
                good = (n["n_words"] >= LEAST_WORDS) & (100 * n["n_repeat_words"] <= REPEATED_PERCENT * n["n_words"]) & (100 * n["kept_chars"] >= KEPT_PERCENT * n["word_chars"])
                columns = part.columns
                columns[place] = made["cleaned"]
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
