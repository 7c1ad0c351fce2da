"""Words of byte arrays, vectorised."""

from __future__ import annotations

import numpy as np

from clausewise.llm.common import Prefixes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def cut(separator: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of each maximal run of bytes that are no separators; rows end runs."""
    if not len(separator):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separator
    head = np.zeros(len(separator) + 1, bool)
    head[offsets] = True  # rows begin here
    begins = inside.copy()
    begins[1:] &= separator[:-1] | head[1:-1]
    ends = inside.copy()
    ends[:-1] &= separator[1:] | head[1:-1]
    first = np.flatnonzero(begins)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(offsets, first, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each blank-separated word, A-Z lower-cased."""
    first, last, row = cut(_BLANK[data], offsets)
    return Prefixes(_LOWER[data]).hash(first, last), row
