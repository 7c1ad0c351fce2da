"""Rolling-hash triggers of byte arrays, and the windows of fixed length between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from clausewise.llm.common import SLICE_BYTES, Prefixes, raw, slices

LENGTH = 200  # bytes of a window that counts as repeated
GRAM = 16  # bytes that the rolling hash covers
SPAN = 128  # the least hash of so many neighbouring places is a trigger
HEAD = LENGTH - SPAN  # bytes from a window's first trigger that surely lie in the window
REST = LENGTH - SPAN - GRAM + 1  # places from a window's begin to that of its last full span
_PLACE = 31
_PART = 1 << 17  # places that are hashed at once


def segments(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets, row, base): runs of texts of about `limit` bytes; row and base say which row each text is of and where in it.

    A longer text comes in segments that share LENGTH - 1 bytes, so that each of its windows lies in one segment. As all
    that is computed of a window follows from its own bytes, segments change no result.
    """
    for rows, text in slices(batches, limit=limit):
        data, offsets = raw(text)
        if len(data) <= 2 * limit:
            yield rows, data, offsets, np.arange(rows.num_rows), np.zeros(rows.num_rows, np.int64)
            continue
        for row in range(rows.num_rows):
            own = data[offsets[row] : offsets[row + 1]]
            for base in range(0, max(1, len(own) - LENGTH + 1), limit):
                part = own[base : base + limit + LENGTH - 1]
                yield rows, part, np.array([0, len(part)]), np.array([row]), np.array([base])


class Windows:
    """The windows of all rows of a byte array, with the first and last trigger that each fixes by its own bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.prefix = Prefixes(data)
        grams = max(len(data) - GRAM + 1, 0)
        packed = np.empty(grams, np.uint64)
        for a in range(0, grams, _PART):
            place = np.arange(a, min(a + _PART, grams))
            packed[place] = self.prefix.hash(place, place + GRAM) & ~np.uint64((1 << _PLACE) - 1) | place.astype(np.uint64)
        step = 1
        while step < min(SPAN, grams):
            np.minimum(packed[: grams - step], packed[step:], out=packed[: grams - step])
            step *= 2
        packed &= np.uint64((1 << _PLACE) - 1)
        least = packed.astype(np.int32)
        del packed
        # 32 bits hold a place, and take half the memory
        count = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
        self.row = np.repeat(np.arange(len(count), dtype=np.int32), count)
        first = np.r_[0, np.cumsum(count)][:-1]
        self.at = np.arange(count.sum(), dtype=np.int32) - np.repeat((first - offsets[:-1]).astype(np.int32), count)
        self.first = least[self.at]
        self.last = least[self.at + (REST - 1)]
