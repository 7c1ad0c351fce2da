"""Toxicity by a factorization machine over hashed terms.

The score is a logistic of bias, linear weights and the pairwise products of the terms' factors, so that a pair of
terms (an insult with the mention of a group, say) can weigh what neither does alone.

Defined results: a null or empty text has no terms and gets the score of the bias; rows are kept one for one, repeated
ids included; a null id stays null and is not held out; other columns are ignored (without_toxic() keeps them all);
texts are read whole. With one label only, the score is the share of label 1 (0.001 or 0.999 at the ends); without
labelled rows it is 0.5. No documents give no rows. without_toxic() judges each row by itself, repeated ones alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import Prefixes, mix, raw, slices
from clausewise.llm.labelled import SAMPLE_ROWS, fitted, sample, scored
from clausewise.llm.words import cut

BITS = 21
BUCKETS = 1 << BITS
FACTORS = 8
STEMS = (3, 4, 6)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(text: pa.StringArray, slots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of each text's words and word beginnings (STEMS bytes), end to end, and their offsets.

    With slots, the slot of each bucket instead, without those that have none (-1).
    """
    data, offsets = raw(text)
    first, last, row = cut(~_LETTER[data], offsets)
    prefix = Prefixes(_LOWER[data])
    hashes, rows = [prefix.hash(first, last)], [row]
    for stem in STEMS:
        long = last - first > stem
        hashes.append(mix(prefix.hash(first[long], first[long] + stem) + np.uint64(stem)))
        rows.append(row[long])
    bucket, row = (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(rows)
    if slots is not None:
        bucket = slots[bucket].astype(np.int64)
        row, bucket = row[bucket >= 0], bucket[bucket >= 0]
    pair = np.unique(row << BITS | bucket)
    return pair & (BUCKETS - 1), np.r_[0, np.cumsum(np.bincount(pair >> BITS, minlength=len(text)))].astype(np.int64)


class Machine:
    """A fitted machine: bias, and for each bucket that has weights its linear weight and factors."""

    def __init__(self, bias: float, buckets: np.ndarray, linear: np.ndarray, factors: np.ndarray):
        self.bias, self.buckets, self.linear, self.factors = bias, buckets.astype(np.int32), linear.astype(np.float32), factors.astype(np.float32)
        self._slots: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_slots": None}

    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.full(BUCKETS, -1, np.int32)
            self._slots[self.buckets] = np.arange(len(self.buckets))
        return self._slots

    def margin(self, slot: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.full(len(offsets) - 1, self.bias)
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            head = offsets[:-1][full]
            factor = self.factors[slot]
            total = np.add.reduceat(factor, head, axis=0)
            squares = np.add.reduceat((factor * factor).sum(axis=1), head)
            out[full] += np.add.reduceat(self.linear[slot], head) + 0.5 * ((total * total).sum(axis=1) - squares)
        return out

    def score(self, text: pa.StringArray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(*terms(text, self.slots())), -30, 30)))


def fit(rows: list[np.ndarray], label: np.ndarray, epochs: int = 20, rate: float = 0.1, decay: float = 1e-3, seed: int = 7, least: int = 8) -> Machine:
    """Adaptive-gradient descent on the log loss over one example after another; rows: each example's buckets.

    Terms of fewer than `least` examples have no weights.
    """
    rng = np.random.default_rng(seed)
    share = float(np.clip(label.mean() if len(label) else 0.5, 1e-3, 1 - 1e-3))
    bias = float(np.log(share / (1 - share)))
    if len(set(label.tolist())) < 2:
        return Machine(bias, np.zeros(0), np.zeros(0), np.zeros((0, FACTORS)))
    count = np.bincount(np.concatenate(rows), minlength=BUCKETS)
    buckets = np.flatnonzero(count >= min(least, max(1, len(rows) // 50)))
    slots = np.full(BUCKETS, -1)
    slots[buckets] = np.arange(len(buckets))
    rows = [slots[b][slots[b] >= 0] for b in rows]
    linear, factors = np.zeros(len(buckets)), rng.normal(0, 0.01, (len(buckets), FACTORS))
    seen_linear, seen_factors, seen_bias = np.full(len(buckets), 1e-2), np.full((len(buckets), FACTORS), 1e-2), 1e-2
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            b = rows[i]
            factor = factors[b]
            total = factor.sum(axis=0)
            margin = bias + linear[b].sum() + 0.5 * float((total * total).sum() - (factor * factor).sum())
            wrong = 1 / (1 + np.exp(-min(30.0, max(-30.0, margin)))) - label[i]
            if abs(wrong) < 1e-3:
                continue
            seen_bias += wrong * wrong
            bias -= rate * wrong / seen_bias**0.5
            if not len(b):
                continue
            step = wrong + decay * linear[b]
            seen_linear[b] += step * step
            linear[b] -= rate * step / np.sqrt(seen_linear[b])
            step = wrong * (total - factor) / len(b) ** 0.5 + decay * factor
            seen_factors[b] += step * step
            factors[b] -= rate * 0.2 * step / np.sqrt(seen_factors[b])
    return Machine(bias, buckets, linear, factors)


def _packed(text: pa.StringArray) -> list[bytes]:
    bucket, offsets = terms(text)
    return [bucket[offsets[i] : offsets[i + 1]].astype(np.int32).tobytes() for i in range(len(text))]


def _fit_packed(rows: list[bytes], label: np.ndarray) -> Machine:
    return fit([np.frombuffer(x, np.int32) for x in rows], label)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Machine:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    return fitted(sample(docs, labels, "toxic", rows), _packed, _fit_packed)


def toxicity(docs: DataFrame, machine: Machine, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for each row."""
    return scored(docs.select(F.col(id_col), F.col(text_col).alias("text")), machine.score, threshold, id_col)


def without_toxic(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, text in slices(batches):
            yield rows.filter(pa.array(machine.score(text) < threshold))

    return docs.mapInArrow(run, docs.schema)
