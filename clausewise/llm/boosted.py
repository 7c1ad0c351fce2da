"""Document quality by histogram gradient-boosted trees over document statistics.

Statistics are cut into bins at sample quantiles; each tree takes the split of greatest gain over the bins' sums of
gradients. Fitted trees are flattened into arrays, and a batch of documents walks all of them level by level in numpy.

Defined results: a null or empty text has statistics of zero; rows are kept one for one, repeated ids included; a null
id stays null and is not held out; other columns are ignored; texts are read whole. With one label only, the score is
the share of label 1 (0.001 or 0.999 at the ends); without labelled rows it is 0.5. No documents give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import Prefixes, raw
from clausewise.llm.labelled import SAMPLE_ROWS, fitted, sample, scored
from clausewise.llm.words import cut

BINS, DEPTH, TREES, RATE = 64, 5, 120, 0.1

_CLASS = np.zeros(256, np.uint8)  # 0 symbols, 1 lower, 2 upper, 3 digit, 4 blank, 5 beyond ASCII, 6 end of sentence, 7 comma and its like, 8 continuation
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[9, 10, 11, 12, 13, 32]], _CLASS[192:256], _CLASS[128:192] = 1, 2, 3, 4, 5, 8
for _c in b".?!":
    _CLASS[_c] = 6
for _c in b",;:'\"-":
    _CLASS[_c] = 7
_KINDS = 9


def _sum(value: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, value, minlength=n)


def statistics(text: pa.StringArray) -> np.ndarray:
    """A row of statistics for each text."""
    data, offsets = raw(text)
    n = len(text)
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    kind = _CLASS[data]
    counts = np.bincount(row * _KINDS + kind, minlength=n * _KINDS).reshape(n, _KINDS).astype(float)
    safe = np.maximum(size, 1)
    out = [size, *(counts / safe[:, None]).T]
    first, last, owner = cut(kind == 4, offsets)
    prefix = Prefixes(data)
    word = prefix.hash(first, last)
    words = np.bincount(owner, minlength=n)
    some = np.maximum(words, 1)
    length = (last - first).astype(float)
    mean = _sum(length, owner, n) / some
    order = np.lexsort((word, owner))
    same = np.zeros(len(word), bool)
    same[1:] = (word[order][1:] == word[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    own = owner[order]
    out += [words, mean, np.sqrt(np.maximum(_sum(length * length, owner, n) / some - mean * mean, 0)), _sum(same, own, n) / some]
    out += [_sum(length == 1, owner, n) / some, _sum(length > 15, owner, n) / some]
    if len(first):
        begin, end = kind[first], kind[last - 1]
        out += [_sum(begin == k, owner, n) / some for k in (0, 2, 3)] + [_sum(end == k, owner, n) / some for k in (0, 2, 6, 7)]
        pair = np.zeros(len(word), np.uint64)
        pair[1:] = word[1:] * np.uint64(3) + word[:-1]
        order = np.lexsort((pair, owner))
        same[1:] = (pair[order][1:] == pair[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        out.append(_sum(same, owner[order], n) / some)
    else:
        out += [np.zeros(n)] * 8
    first, last, owner = cut(data == 10, offsets)
    lines = np.bincount(owner, minlength=n)
    some = np.maximum(lines, 1)
    line = prefix.hash(first, last)
    order = np.lexsort((line, owner))
    same = np.zeros(len(line), bool)
    same[1:] = (line[order][1:] == line[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out += [lines, _sum(last - first, owner, n) / some, _sum(same, owner[order], n) / some, _sum(kind[last - 1] == 6, owner, n) / some if len(first) else np.zeros(n)]
    for symbol in b"|{}<>#$%&*=/\\[]()_@+":
        out.append(np.bincount(row[data == symbol], minlength=n) / safe)
    return np.stack([np.asarray(x, float) for x in out], axis=1)


class Trees:
    """Fitted trees, flattened: for each node its statistic, limit and children; leaves point at themselves."""

    def __init__(self, feature: np.ndarray, limit: np.ndarray, left: np.ndarray, right: np.ndarray, value: np.ndarray, roots: np.ndarray, bias: float):
        self.feature, self.limit, self.left, self.right, self.value, self.roots, self.bias = feature, limit, left, right, value, roots, bias

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), self.bias)
        node = np.repeat(self.roots[None], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            node = np.where(x[rows, self.feature[node]] <= self.limit[node], self.left[node], self.right[node])
        return self.bias + self.value[node].sum(axis=1)

    def score(self, text: pa.StringArray) -> np.ndarray:
        x = statistics(text)
        return np.concatenate([1 / (1 + np.exp(-self.margin(x[i : i + 1024]))) for i in range(0, len(x), 1024)]) if len(x) else np.zeros(0)


def fit(x: np.ndarray, label: np.ndarray, trees: int = TREES, least: int = 20, ridge: float = 1.0) -> Trees:
    """Newton boosting on the log loss; nodes are split level by level to DEPTH."""
    share = float(np.clip(label.mean() if len(label) else 0.5, 1e-3, 1 - 1e-3))
    bias = float(np.log(share / (1 - share)))
    feature, limit, left, right, value, roots = [], [], [], [], [], []
    if len(set(label.tolist())) == 2:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        width = x.shape[1]
        margin = np.full(len(x), bias)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            gradient, weight = p - label, np.maximum(p * (1 - p), 1e-9)
            groups = [(len(feature), np.arange(len(x)))]
            roots.append(len(feature))
            _add(feature, limit, left, right, value)
            for level in range(DEPTH + 1):
                nxt = []
                for node, rows in groups:
                    g, h = gradient[rows].sum(), weight[rows].sum()
                    value[node] = -RATE * g / (h + ridge)
                    if level == DEPTH or len(rows) < 2 * least:
                        margin[rows] += value[node]
                        continue
                    cell = (binned[rows] + np.arange(width) * BINS).ravel()
                    sums = [np.bincount(cell, w if w is None else np.repeat(w[rows], width), minlength=width * BINS).reshape(width, BINS).cumsum(axis=1) for w in (gradient, weight, None)]
                    gl, hl, nl = sums
                    gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                    gain[(nl < least) | (len(rows) - nl < least)] = 0
                    best = int(gain.argmax())
                    f, b = divmod(best, BINS)
                    if gain[f, b] <= 1e-6 or b >= len(edges[f]):
                        margin[rows] += value[node]
                        continue
                    feature[node], limit[node] = f, float(edges[f][b])
                    low = binned[rows, f] <= b
                    left[node], right[node] = len(feature), len(feature) + 1
                    for side in (rows[low], rows[~low]):
                        nxt.append((len(feature), side))
                        _add(feature, limit, left, right, value)
                groups = nxt
    inner = np.array(left, np.int64) != np.arange(len(left))
    return Trees(np.array(feature, np.int64), np.array(limit), np.array(left, np.int64), np.array(right, np.int64), np.where(inner, 0.0, np.array(value)), np.array(roots, np.int64), bias)


def _add(feature: list, limit: list, left: list, right: list, value: list) -> None:
    at = len(feature)
    for held, new in ((feature, 0), (limit, 0.0), (left, at), (right, at), (value, 0.0)):
        held.append(new)


def _packed(text: pa.StringArray) -> list[bytes]:
    return [x.tobytes() for x in statistics(text)]


def _fit_packed(rows: list[bytes], label: np.ndarray) -> Trees:
    return fit(np.array([np.frombuffer(x) for x in rows]).reshape(len(rows), -1) if rows else np.zeros((0, 1)), label)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    return fitted(sample(docs, labels, "quality", rows), _packed, _fit_packed)


def quality(docs: DataFrame, trees: Trees, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for each row."""
    return scored(docs.select(F.col(id_col), F.col(text_col).alias("text")), trees.score, threshold, id_col)
