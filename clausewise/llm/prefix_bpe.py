"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a pre-token exactly one token can be the last of its encoding: the suffix-automaton match whose
predecessor (the last token of the shorter prefix) forms a compatible pair with it, that is, a pair which the merges
would keep apart. The last tokens are stored and followed back to give the exact ids.

Defined results: a null or empty text has no ids (digests of nothing); rows are kept one for one, repeated ids
included; a null id stays null; other columns are ignored; very long texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from clausewise.llm.common import slices

#: The pre-token pattern of byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose ids a worker keeps.
KNOWN = 300_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next free code from 256."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixEncoder:
    """The vocabulary of a byte-level tokenizer .json with its automaton and merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["model"]["type"] != "BPE":
            raise ValueError("needs a byte-level BPE tokenizer without normaliser or prefix space")
        alphabet = byte_alphabet()
        vocabulary = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.bytes: list[bytes] = [b""] * (1 + max([*vocabulary.values(), *special.values()]))
        for token, i in vocabulary.items():
            if token not in special:
                self.bytes[i] = bytes(alphabet[c] for c in token)
        ids = {b: i for i, b in enumerate(self.bytes) if b}
        for token, i in special.items():
            self.bytes[i] = token.encode()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            left, right = vocabulary[left], vocabulary[right]
            whole = ids[self.bytes[left] + self.bytes[right]]
            self.merges[left, right] = (rank, whole)
            self.parts.setdefault(whole, (left, right))
            self.rank.setdefault(whole, rank)
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, bytes] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave the two tokens side by side: no merge across their border comes before both are whole.

        The border symbols of the two derivations are undone step by step, the later-made side first; a merge of two
        border symbols of lower rank than the step undone would have happened instead.
        """
        found = self.fits.get((left, right))
        if found is not None:
            return found
        a, b, limit, good = left, right, 1 << 60, True
        while True:
            across = self.merges.get((a, b))
            if across is not None and across[0] < limit:
                good = False
                break
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                limit, a = ra, self.parts[a][1]
            else:
                # of equal ranks the left one is made first, so the right one is undone first
                limit, b = rb + 1, self.parts[b][0]
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[left, right] = good
        return good

    def encode_word(self, word: str) -> list[int]:
        """The ids of one pre-token."""
        data = word.encode()
        last, size = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        filled = -1
        for end, (token, length) in self.automaton.iter(data.decode("latin-1")):
            if end == filled:
                continue
            begin = end + 1 - length
            if begin == 0 or last[begin] >= 0 and self.compatible(last[begin], token):
                last[end + 1], size[end + 1] = token, length
                filled = end
        out, at = [], len(data)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.cut and any(t in text for t in self.special):
            parts = self.cut.split(text)
            return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self._plain(p) for p in parts)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        words, known = self.pattern.findall(text), self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            if len(known) > KNOWN:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = np.array(self.encode_word(w), "<u4").tobytes()
            return b"".join([known[w] for w in words])

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens kept; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for rows, text in slices(batches):
            ids = [tool.encode(t) for t in text.to_pylist()]
            ends = pa.array(np.r_[0, np.cumsum([len(x) // 4 for x in ids])].astype(np.int32))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))], names=[id_col, "ids"])

    return docs.select(docs[id_col], docs[text_col].alias("text")).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for each row of ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for rows in batches:
            text = [tool.decode(np.array(x or [], "<u4").tobytes()) for x in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(text, pa.string())], names=[id_col, "text"])

    return encoded.select(encoded[id_col], encoded[ids_col]).mapInArrow(run, f"`{id_col}` {dict(encoded.dtypes)[id_col]}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): the text encoded, and its ids decoded again. One scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for rows, text in slices(batches):
            counts, encoded, decoded = [], [], []
            for t in text.to_pylist():
                ids = tool.encode(t)
                counts.append(len(ids) // 4)
                encoded.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(tool.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts, pa.int64()), pa.array(encoded), pa.array(decoded)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[id_col], docs[text_col].alias("text")).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
