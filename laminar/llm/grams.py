"""Words of many texts as numbers, and which of their grams recur within the same text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def word_codes(flat: pa.Array) -> np.ndarray:
    """A number for each word of a batch, the same for equal words."""
    return flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def owners(offsets: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def occurrences(keys: np.ndarray, at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions ``at`` (ascending) ordered by key, then place; the number of each one's key; whether the one after it is
    the next occurrence of the same key in the same text."""
    order = np.argsort(keys, kind="stable")
    held, placed = keys[order], at[order]
    same = held[1:] == held[:-1]
    number = np.concatenate([[0], np.cumsum(~same)]) if len(held) else np.zeros(0, dtype=np.int64)
    follows = same & (owner[placed[1:]] == owner[placed[:-1]])
    return placed, number, np.concatenate([follows, np.zeros(min(len(held), 1), dtype=bool)])


def joined(left: np.ndarray, gap: int, right: np.ndarray, at: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams made of two known ones: those positions of ``at`` where ``length`` words stand in the text and both parts, the
    second ``gap`` words on, are numbered (0 or more), with a key for each pair of numbers."""
    at = at[at + length <= ends[at]]
    at = at[(left[at] >= 0) & (right[at + gap] >= 0)]
    return at, left[at] * (int(right.max(initial=0)) + 1) + right[at + gap]


def numbered(size: int, placed: np.ndarray, number: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """For every word of the batch the number of the gram that starts there, -1 where that gram does not recur in its text."""
    out = np.full(size, -1, dtype=np.int64)
    recurs = follows.copy()
    recurs[1:] |= follows[:-1]
    out[placed[recurs]] = number[recurs]
    return out


def covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``size`` places lie in one of the spans (end exclusive)."""
    steps = np.zeros(size + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0
