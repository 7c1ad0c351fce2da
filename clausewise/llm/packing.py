"""Best-fit packing planned on the histogram of piece lengths.

Documents are cut into pieces; only the counts of the lengths (at most as many as a sequence has tokens) reach the
driver, where best-fit decreasing runs over counts instead of pieces. The plan is a list of runs: so many pieces of a
length take so many places in consecutive sequences. Each piece then finds its run by its rank within its length.

Defined results: a null or empty text is one piece that holds the end token alone; rows are kept one for one, so rows
that repeat an id give pieces that repeat (doc_id, piece) but have places of their own; a null id stays null; other
columns are ignored, whatever their names; very long texts are encoded whole, runs of millions of blanks too. No
documents give no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausewise.llm.common import slices, staged
from clausewise.llm.prefix_bpe import PATTERN, byte_alphabet, encoder

CAPACITY, END = 1024, 2
_SHIFT = np.int64(40)
#: Runs of blanks beyond this are encoded by the prefix encoder: the fast library's pattern gives up on some of a million.
LONG_RUN = 100_000
_BLANKS = re.compile(r"\s+")


@lru_cache(maxsize=2)
def token_ids(path: str):
    """A function from a text to its ids under a byte-level tokenizer .json, by the fast library where ids are merge ranks."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocabulary = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    ranked = all(vocabulary[bytes(alphabet[c] for c in a + b)] == 256 + k for k, (a, b) in enumerate(merges))
    if ranked and not spec["normalizer"] and not spec["pre_tokenizer"].get("add_prefix_space"):
        import tiktoken

        tool = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens=special)

        def fast(text: str) -> np.ndarray:
            if len(text) > LONG_RUN and any(m.end() - m.start() > LONG_RUN for m in _BLANKS.finditer(text)):
                return np.frombuffer(encoder(path).encode(text), "<u4")
            return tool.encode_to_numpy(text, allowed_special="all")

        return fast
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.no_truncation()
    slow.no_padding()
    return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): texts encoded with the end token, long ones cut, the short piece first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(path)
        for rows, text in slices(batches):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, t in enumerate(text.to_pylist()):
                own = np.append(encode(t), end).astype("<u4")
                a, k = 0, 0
                while a < len(own):
                    b = a + ((len(own) - a) % capacity or capacity)
                    row.append(i), piece.append(k), start.append(a), length.append(b - a)
                    crc.append(zlib.crc32(own[a:b].tobytes()))
                    if with_ids:
                        ids.append(own[a:b].astype(np.int32))
                    a, k = b, k + 1
            columns = [rows.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)].astype(np.int32)), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first sequence, pieces in each sequence, offset) of best-fit decreasing over counts.

    Sequences with equal room are kept as ranges, so the number of runs follows the number of lengths, not of pieces.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # room -> ranges (first sequence, how many)
    rooms: list[int] = []
    runs, sequences = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in free:
                free[room] = []
                insort(rooms, room)
            free[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = free[room].pop()
                if not free[room]:
                    del free[room], rooms[at]
            else:
                room, first = capacity, sequences
                n = -(-left // (room // length))
                sequences += n
            # one sequence after another takes pieces as long as it has room, being the tightest
            each = min(room // length, left)
            used = min(n, left // each)
            runs.append((length, rank, first, each, capacity - room))
            put(room - each * length, first, used)
            put(room, first + used, n - used)
            left -= used * each
            rank += used * each
    return runs


def _ranked(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pieces with their rank within their length, counts of lengths).

    Ranks are row numbers within (length, part of the pieces) on top of the counts of the parts before, so that no
    length meets in one task.
    """
    parts = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32"), F.lit(parts)).cast("int"))
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = cut.withColumn("row", F.row_number().over(within)).join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("row") - 1).drop("part", "row", "base")
    return ranked, counts.groupBy("length").agg(F.sum("n").alias("n"))


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The columns of cut (pieces()) with sequence_id and offset, as few sequences as best-fit decreasing finds."""
    ranked, counts = _ranked(cut)
    histogram = {r.length: r.n for r in counts.collect()}  # at most `capacity` rows
    runs = sorted(plan(histogram, capacity))
    length, rank, first, each, offset = (np.array([r[i] for r in runs], np.int64) for i in range(5))
    start = length << _SHIFT | rank
    names = [*cut.columns, "sequence_id", "offset"]
    at = ranked.columns.index("length"), ranked.columns.index("rank")
    order = [ranked.columns.index(c) for c in cut.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            own, place = (rows.column(i).to_numpy() for i in at)
            k = np.searchsorted(start, own << _SHIFT | place, "right") - 1
            nth = place - rank[k]
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in order), pa.array(first[k] + nth // each[k]), pa.array(offset[k] + nth % each[k] * own)], names=names)

    schema = ", ".join(f"`{c}` {t}" for c, t in cut.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def best_fit(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece. Texts are encoded once."""
    return packed(staged(pieces(docs, path, capacity, end), "pieces"), capacity)
