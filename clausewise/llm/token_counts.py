"""Token counts of a piece vocabulary with byte fallback, by rank-synchronous merging over ragged arrays.

Texts are cut before each run of blanks (no piece holds a blank after another character), equal pre-tokens of a slice
are merged once, and in each round every pre-token applies its lowest-rank pair; what is left is counted.

Defined results: a null or empty text has 0 bytes and 0 tokens; rows are kept one for one, repeated ids included; a
null id stays null; other columns are ignored. Blanks are counted as the library does: a leading blank is added, runs
are kept. Very long texts are counted whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from clausewise.llm.common import slices

BLANK = "▁"
NONE = np.int64(1) << 40
KNOWN = 400_000


class PieceMerger:
    """Vocabulary, pair table and ranks of a .model file, and the array merge over them."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("needs a BPE model with identity normalisation, kept blanks and a leading blank")
        ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        if any(BLANK in p.lstrip(BLANK) for p in ids):
            raise ValueError("a piece holds a blank after another character")
        _, rank = np.unique([-p.score for p in proto.pieces], return_inverse=True)  # equal scores share a rank
        self.size = len(proto.pieces)
        self.symbol = np.full(0x110000, -1, np.int64)
        for p, i in ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        pairs = {}
        for p, i in ids.items():
            for cut in range(1, len(p)):
                left, right = ids.get(p[:cut]), ids.get(p[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.rank = rank.astype(np.int64)
        self.known: dict[str, int] = {}

    def counts(self, words: list[str]) -> np.ndarray:
        """count(), with the pre-tokens met before kept in a table of at most KNOWN entries."""
        known = self.known
        fresh = [w for w in words if w not in known]
        if len(known) + len(fresh) > KNOWN:
            known.clear()
            fresh = words
        found = dict(zip(fresh, self.count(fresh).tolist(), strict=True))
        known.update((w, n) for w, n in found.items() if len(w) <= 32)
        return np.fromiter((found[w] if w in found else known[w] for w in words), np.int64, len(words))

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair; NONE and -1 where it does not merge."""
        key = np.where((left < 0) | (right < 0), -1, left * self.size + right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        piece = np.where(hit, self.merged[at], -1)
        return np.where(hit, self.rank[piece], NONE), piece

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token, in which blanks are already marked."""
        total = np.zeros(len(words), np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return total
        seq = np.repeat(np.arange(len(words)), lengths)
        sym = self.symbol[points]
        # an unknown character falls back to its bytes
        extra = np.where(sym < 0, (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF), 0)
        np.add.at(total, seq, extra)
        rank, piece = self._ranks(sym, seq)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            if (low == NONE).any():
                done = low == NONE
                total[seq[starts[done]]] += sizes[done]
                keep = np.repeat(~done, sizes)
                sym, seq, rank, piece = sym[keep], seq[keep], rank[keep], piece[keep]
                if not len(sym):
                    break
                low, sizes = low[~done], sizes[~done]
            least = np.repeat(low, sizes)
            at = np.flatnonzero(rank == least)
            head = np.r_[True, seq[at][1:] != seq[at][:-1]]  # each sequence's leftmost pair
            fresh = np.r_[True, at[1:] != at[:-1] + 1] | head
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            odd = (np.arange(len(at)) - run) % 2 == 1  # it overlaps the pair before
            at, head = at[~odd], head[~odd]
            new = self._apply(sym, seq, rank, piece, at)
            if len(at) > head.sum():
                # further pairs of the same rank may go in the same round only if no pair that they make comes first
                after = np.minimum(at + 2, len(sym) - 1)
                nearby, _ = self.pair(piece[at], np.where((after == at + 2) & (seq[after] == seq[at]), sym[after], -1))
                risky = np.zeros(len(total), bool)
                risky[seq[at[nearby <= least[at]]]] = True
                level = np.full(len(total), -1, np.int64)
                level[seq[at]] = least[at]
                risky[new[1][new[2] <= level[new[1]]]] = True
                if (risky[seq[at]] & ~head).any():
                    at = at[head | ~risky[seq[at]]]
                    new = self._apply(sym, seq, rank, piece, at)
            sym, seq, rank, piece = new
        return total

    def _ranks(self, sym: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, piece = np.full(len(sym), NONE, np.int64), np.full(len(sym), -1, np.int64)
        same = np.flatnonzero(seq[1:] == seq[:-1])
        rank[same], piece[same] = self.pair(sym[same], sym[same + 1])
        return rank, piece

    def _apply(self, sym, seq, rank, piece, at):
        """Merge the pairs that begin at `at` and look up the pairs beside them."""
        sym, rank, piece = sym.copy(), rank.copy(), piece.copy()
        sym[at] = piece[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        place = np.cumsum(keep) - 1
        at = place[at]
        sym, seq, rank, piece = sym[keep], seq[keep], rank[keep], piece[keep]
        touched = np.unique(np.r_[at, at[at > 0] - 1])
        nxt = np.minimum(touched + 1, len(sym) - 1)
        inside = (nxt == touched + 1) & (seq[nxt] == seq[touched])
        rank[touched], piece[touched] = NONE, -1
        touched, nxt = touched[inside], nxt[inside]
        rank[touched], piece[touched] = self.pair(sym[touched], sym[nxt])
        return sym, seq, rank, piece


@lru_cache(maxsize=2)
def merger(path: str) -> PieceMerger:
    return PieceMerger(path)


def count_texts(model: PieceMerger, text: pa.StringArray) -> np.ndarray:
    """Tokens of each text."""
    odd = pc.or_(pc.or_(pc.match_substring(text, "  "), pc.match_substring(text, BLANK)), pc.starts_with(text, " "))
    odd = odd.to_numpy(zero_copy_only=False)
    out = np.zeros(len(text), np.int64)
    plain = np.flatnonzero(~odd & (pc.binary_length(text).to_numpy(zero_copy_only=False) > 0))
    if len(plain):
        parts = pc.split_pattern(text.take(pa.array(plain)), " ")
        words = parts.flatten().dictionary_encode()
        each = model.counts([BLANK + w for w in words.dictionary.to_pylist()])
        sums = np.r_[0, np.cumsum(each[words.indices.to_numpy()])]
        ends = np.r_[0, np.cumsum(pc.list_value_length(parts).to_numpy())]
        out[plain] = sums[ends[1:]] - sums[ends[:-1]]
    odd = np.flatnonzero(odd)
    if len(odd):
        # runs of blanks stay with the word after them
        lists = [re.findall(" +[^ ]*", " " + t.replace(BLANK, " ")) for t in text.take(pa.array(odd)).to_pylist()]
        words = pa.array([w for each in lists for w in each], pa.string()).dictionary_encode()
        each = model.counts([w.replace(" ", BLANK) for w in words.dictionary.to_pylist()])
        sums = np.r_[0, np.cumsum(each[words.indices.to_numpy()])]
        ends = np.r_[0, np.cumsum([len(x) for x in lists])]
        out[odd] = sums[ends[1:]] - sums[ends[:-1]]
    return out


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row; over_limit: more than `limit` tokens. One scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merger(model_path)
        for rows, text in slices(batches, limit=1 << 23):
            n = count_texts(model, text)
            yield pa.RecordBatch.from_arrays([rows.column(0), pc.cast(pc.binary_length(text), pa.int64()), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(docs[id_col], docs[text_col].alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
