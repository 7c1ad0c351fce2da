"""Bytes of repeated 200-byte strings, by prefix-free parsing of the whole corpus.

1. Rolling-hash triggers (the least hash of each span) cut every text. A repeated window holds its first trigger with
   the HEAD bytes after it, so triggers whose head occurs once are set aside.
2. The rest of the parse: consecutive windows with the same first and last trigger form an interval. Equal windows
   have equal bytes between those triggers (the key); intervals that are equal as a whole are repeated throughout.
3. Intervals with a common key that differ at their borders are ordered by suffix arrays of dictionary and parse
   (prefix_free), in blocks by key; windows that are neighbours with 200 bytes in common are repeated. A key with more
   than a block holds is parted by the bytes that its windows share, so that a task's arrays stay small.

Equal keys of one slice of a task are merged before the shuffle, so a key has at most one row for each slice.

Defined results: a null or empty text has 0 bytes, 0 removed and the digest of nothing; matches never cross rows; each
row of a repeated one counts as another place; rows are kept one for one; a null id stays null; other columns are
ignored by suffix_dedup() and kept by without_repeats(), whatever their names; texts are read whole, long ones in
segments; no rows give no rows. A text left without characters is empty, a null one stays null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import by_key, mix, raw, slices
from clausewise.llm.prefix_free import BLOCK, in_blocks
from clausewise.llm.triggers import GRAM, HEAD, LENGTH, Windows, segments

SINGLE, COPY, SEVERAL = 0, 1, 2  # one place of its key in a slice; a further one; the first of several
DECIDED, COMPARED = 0, 1
_LOW, _WINDOWS, _LEAD = np.int64((1 << 28) - 1), np.int64((1 << 18) - 1), np.int64((1 << 10) - 1)


def _merged(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """SINGLE, COPY or SEVERAL for each row of a slice, by equal keys; and the sorting order."""
    order = np.lexsort(keys[::-1])
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    before, after = np.r_[False, same], np.r_[same, False]
    state = np.empty(len(order), np.int64)
    state[order] = np.where(before, COPY, np.where(after, SEVERAL, SINGLE))
    return state, order


def _heads(docs: DataFrame) -> DataFrame:
    """(key, uid, place) of each trigger; place holds the state in its two low bits; COPY rows have a free key.

    A trigger near the border of two segments of a long text is given by both, and so passes as repeated; what it holds
    is told later by its bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets, of, base in segments(batches):
            windows = Windows(data, offsets)
            found = np.zeros(len(data) + 1, bool)
            found[windows.first] = found[windows.last] = True
            at = np.flatnonzero(found)
            row = np.searchsorted(offsets, at, "right") - 1
            inside = at + HEAD <= offsets[row + 1] if len(at) else np.zeros(0, bool)
            at, row = at[inside], row[inside]
            if not len(at):
                continue
            key = windows.prefix.hash(at, at + HEAD)
            state, _ = _merged(key)
            uid = rows.column(0).to_numpy()[of[row]]
            place = at - offsets[row] + base[row]
            key = np.where(state == COPY, mix(uid.view(np.uint64) + place.astype(np.uint64)), key)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(uid), pa.array(place << 2 | state)], names=["key", "uid", "place"])

    return docs.select("uid", "text").mapInArrow(run, "key long, uid long, place long")


def _repeated_heads(heads: DataFrame) -> DataFrame:
    """(uid, place) of the triggers whose head occurs again."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, place = table.column(0).to_numpy(), table.column(2).to_numpy()
        state = place & 3
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        real = np.add.reduceat(np.where(state == COPY, 0, np.where(state == SEVERAL, 2, 1)), first)
        group = np.repeat(real, np.diff(np.r_[first, len(key)]))
        keep = (state == COPY) | (group > 1)
        yield pa.RecordBatch.from_arrays([pa.array(table.column(1).to_numpy()[keep]), pa.array(place[keep] >> 2)], names=["uid", "place"])

    return heads.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: by_key(batches, work), "uid long, place long")


def _first(df: DataFrame, *names: str) -> DataFrame:
    """df with the named columns first; the others stay, so that all joins with the texts read one and the same exchange."""
    return df.select(*names, *(F.col(f"`{c}`") for c in df.columns if c not in names))


def _intervals(texts: DataFrame) -> DataFrame:
    """(key, whole, uid, vid, span) of the intervals whose triggers are repeated; texts: (uid, text, places, vid).

    span: begin << 28 | first trigger's place from there << 18 | number of windows << 2 | state; both are at most SPAN. Rows
    known as repeated by themselves have a free key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets, of, base in segments(batches):
            windows = Windows(data, offsets)
            if not len(windows.at):
                continue
            places = rows.column(2).take(pa.array(of))
            owner = np.repeat(np.arange(len(of)), pc.list_value_length(places).to_numpy())
            at = places.flatten().to_numpy() - base[owner]
            inside = (at >= 0) & (at < np.diff(offsets)[owner])
            good = np.zeros(len(data) + 1, bool)
            good[(at + offsets[owner])[inside]] = True
            # the last trigger counts where its head lies in the window
            fits = good[windows.first] & (good[windows.last] | (windows.last + HEAD > windows.at + LENGTH))
            hit = np.flatnonzero(fits)
            if not len(hit):
                continue
            first, last, at, row = windows.first[hit], windows.last[hit], windows.at[hit], windows.row[hit]
            new = np.r_[True, (first[1:] != first[:-1]) | (last[1:] != last[:-1]) | (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])]
            heads = np.flatnonzero(new)
            n = np.diff(np.r_[heads, len(hit)])
            first, last, begin, row = (x[heads].astype(np.int64) for x in (first, last, at, row))
            key = windows.prefix.hash(first, last + GRAM)
            whole = windows.prefix.hash(begin, begin + n - 1 + LENGTH) + mix((first - begin << 32 | n).astype(np.uint64))
            state, _ = _merged(key, whole)
            uid, vid = (rows.column(i).to_numpy()[of[row]] for i in (0, 3))
            span = begin - offsets[row] + base[row] << 28 | first - begin << 18 | n << 2 | state
            key = np.where(state == COPY, mix(uid.view(np.uint64) + span.view(np.uint64)), key)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(uid), pa.array(vid), pa.array(span)], names=["key", "whole", "uid", "vid", "span"])

    return _first(texts, "uid", "text", "places", "vid").mapInArrow(run, "key long, whole long, uid long, vid long, span long")


def _decided(intervals: DataFrame) -> DataFrame:
    """(state, key, uid, vid, span): DECIDED spans are repeated; of COMPARED ones the windows are to be ordered by key."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, whole, uid, vid, span = (table.column(i).to_numpy() for i in range(5))
        state = span & 3
        kind = np.r_[True, (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])] | (state == COPY)
        first = np.flatnonzero(kind)
        size = np.diff(np.r_[first, len(key)])
        again = np.repeat(np.add.reduceat(1 + (state != SINGLE), first) > 1, size)
        group = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        kinds = np.repeat(np.add.reduceat((kind & (state != COPY)).astype(np.int64), group), np.diff(np.r_[group, len(key)]))
        compare = kind & (state != COPY) & (kinds > 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[np.full(again.sum(), DECIDED), np.full(compare.sum(), COMPARED)].astype(np.int32)), pa.array(np.r_[key[again], key[compare]]), pa.array(np.r_[uid[again], uid[compare]]), pa.array(np.r_[vid[again], vid[compare]]), pa.array(np.r_[span[again], span[compare]])],
            names=["state", "key", "uid", "vid", "span"],
        )

    return intervals.repartition("key").sortWithinPartitions("key", "whole").mapInArrow(lambda batches: by_key(batches, work), "state int, key long, uid long, vid long, span long")


def _fragments(texts: DataFrame) -> DataFrame:
    """(key, uid, vid, place, bytes) of the spans to compare; texts: (uid, text, spans array<struct<key, span>>, vid).

    place: begin << 10 | first trigger's place from there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, text in slices(batches):
            data, offsets = raw(text)
            held = rows.column(2)
            flat, per = held.flatten(), pc.list_value_length(held).to_numpy()
            key, span = flat.field(0), flat.field(1).to_numpy()
            begin, n = span >> 28, (span & _WINDOWS) >> 2
            begin_at = begin + np.repeat(offsets[:-1], per)
            size = n - 1 + LENGTH
            ends = np.r_[0, np.cumsum(size)]
            take = np.arange(ends[-1]) + np.repeat(begin_at - ends[:-1], size)
            out = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[take].tobytes())])
            uid, vid = (pa.array(np.repeat(rows.column(i).to_numpy(), per)) for i in (0, 3))
            yield pa.RecordBatch.from_arrays([key, uid, vid, pa.array(span >> 18), out], names=["key", "uid", "vid", "place", "bytes"])

    return _first(texts, "uid", "text", "spans", "vid").mapInArrow(run, "key long, uid long, vid long, place long, bytes binary")


def _compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """(uid, vid, run) of the repeated windows of some keys' fragments."""
    table = table.combine_chunks()
    data, offsets = raw(table.column(4).combine_chunks().cast(pa.binary()))
    key, uid, vid, place = (table.column(i).to_numpy() for i in range(4))
    found = in_blocks(data, offsets, key, place & _LEAD)
    count = np.diff(offsets) - LENGTH + 1
    row = np.repeat(np.arange(len(count)), count)
    at = np.arange(count.sum()) - np.repeat(np.r_[0, np.cumsum(count)][:-1], count)
    head = found & np.r_[True, ~found[:-1] | (row[1:] != row[:-1])]
    tail = found & np.r_[~found[1:] | (row[1:] != row[:-1]), True]
    a, b = np.flatnonzero(head), np.flatnonzero(tail)
    yield pa.RecordBatch.from_arrays([pa.array(uid[row[a]]), pa.array(vid[row[a]]), pa.array((place[row[a]] >> 10) + at[a] << 28 | b - a + LENGTH)], names=["uid", "vid", "run"])


def _ordered(fragments: DataFrame) -> DataFrame:
    """(uid, vid, run) of the repeated windows; run: begin << 28 | bytes."""
    return fragments.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: by_key(batches, _compared, 4096, BLOCK), "uid long, vid long, run long")


def _own(told: str, of: Callable[[F.Column], F.Column]) -> F.Column:
    """What a set that was gathered by uid holds for the row's own vid."""
    return F.transform(F.filter(told, lambda x: x.vid == F.col("vid")), of)


def repeated_runs(texts: DataFrame) -> DataFrame:
    """(uid, told): for each text (uid, vid, text) with repeated strings, the set of (vid, run): ranges begin << 28 | bytes that they cover."""
    places = _repeated_heads(_heads(texts)).groupBy("uid").agg(F.collect_set("place").alias("places"))
    spans = _decided(_intervals(texts.join(places, "uid")))
    compared = spans.where(F.col("state") == COMPARED).groupBy("uid").agg(F.collect_set(F.struct("vid", "key", "span")).alias("told"))
    met = texts.join(compared, "uid").withColumn("spans", _own("told", lambda x: F.struct(x.key.alias("key"), x.span.alias("span")))).drop("told")
    ordered = _ordered(_fragments(met.where("size(spans) > 0")))
    bytes_of = F.shiftright("span", 28) * F.lit(1 << 28) + F.shiftright("span", 2).bitwiseAND(F.lit((1 << 16) - 1)) - 1 + LENGTH
    runs = spans.where(F.col("state") == DECIDED).select("uid", "vid", bytes_of.alias("run")).union(ordered)
    return runs.groupBy("uid").agg(F.collect_set(F.struct("vid", "run")).alias("told"))


def _with_runs(docs: DataFrame, text_col: str, others: list[str]) -> DataFrame:
    """(text, runs, c0, c1, ...) of each row of docs, c0 and on being the other columns by their places."""
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    held = docs.select(name(text_col).alias("text"), *(name(c).alias(f"c{i}") for i, c in enumerate(others)))
    # 128 bits tell rows apart; what holds for one row holds for those that equal it
    told = ["text", *(c for c, kind in held.dtypes[1:] if "map<" not in kind and kind != "variant")]
    texts = held.withColumn("uid", F.xxhash64(*told)).withColumn("vid", F.xxhash64(F.lit(1), *told))
    joined = texts.join(repeated_runs(texts), "uid", "left").withColumn("runs", _own("told", lambda x: x.run))
    return joined.select("text", "runs", *(f"c{i}" for i in range(len(others))))


def merged(runs: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs that ranges begin << 28 | bytes cover, in order."""
    if not runs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    run = np.sort(np.array(runs, np.int64))
    begin, end = run >> 28, np.maximum.accumulate((run >> 28) + (run & _LOW))
    head = np.r_[True, begin[1:] > end[:-1]]
    return begin[head], end[np.r_[np.flatnonzero(head)[1:] - 1, len(end) - 1]]


def _rest(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bytes:
    """What lies outside the runs."""
    return b"".join(data[a:b].tobytes() for a, b in zip(np.r_[0, end], np.r_[begin, len(data)], strict=True))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, text in slices(batches):
            data, offsets = raw(text)
            size, removed, spans, digest = [], [], [], []
            for i, runs in enumerate(rows.column(1).to_pylist()):
                own = data[offsets[i] : offsets[i + 1]]
                begin, end = merged(runs)
                size.append(len(own))
                removed.append(int((end - begin).sum()))
                spans.append(len(begin))
                digest.append(hashlib.sha256(_rest(own, begin, end)).hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column(2), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(digest, pa.string())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_runs(docs, text_col, [id_col]).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of docs, the characters that lie wholly in repeated strings removed from the text."""
    names = docs.columns
    place = names.index(text_col)
    others = [c for c in names if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, text in slices(batches):
            data, offsets = raw(text)
            new = []
            for i, runs in enumerate(rows.column(1).to_pylist()):
                own = data[offsets[i] : offsets[i + 1]]
                if not runs:
                    new.append(rows.column(0)[i].as_py())
                    continue
                begin, end = merged(runs)
                first = np.r_[np.flatnonzero(own & 0xC0 != 0x80), len(own)]  # where characters begin
                begin, end = first[np.searchsorted(first, begin)], first[np.searchsorted(first, end, "right") - 1]
                new.append(_rest(own, begin, np.maximum(begin, end)).decode())
            columns = [rows.column(2 + i) for i in range(len(others))]
            columns.insert(place, pa.array(new, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return _with_runs(docs, text_col, others).mapInArrow(run, docs.schema)
