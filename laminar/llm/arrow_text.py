"""Small helpers for Arrow functions over texts of any length."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = re.compile(r"[ \t-\r]")


def slices(texts: pa.Array, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Runs (start, stop) of consecutive texts that together have about ``max_bytes`` bytes, one text at least."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for k, n in enumerate(size):
        if k > start and held + n > max_bytes:
            yield start, k
            start, held = k, 0
        held += int(n)
    if len(size) > start:
        yield start, len(size)


def pieces(text: str, max_chars: int) -> Iterator[str]:
    """``text`` in parts of about ``max_chars``, cut only where ASCII white space stands."""
    start = 0
    while len(text) - start > max_chars:
        cut = _SPACE.search(text, start + max_chars)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def per_list_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` within each run of ``offsets``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Flat words between ASCII white space, and the offsets of each text in them."""
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    size = np.asarray(pc.fill_null(pc.binary_length(flat), 0))
    if len(size) and not size.all():  # white space at either end of a text leaves an empty word
        keep = size > 0
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        flat = flat.filter(pa.array(keep))
    return flat, offsets
