"""Audio fingerprints from pitch-class frames, and the alignment of recordings.

Samples become frames of twelve pitch classes; an integral image over (time, pitch class) gives the areas of 16 filters
in constant time, each quantised to two bits: one packed 32-bit integer for each frame. Every query meets every recording
at every offset that leaves overlap enough; most offsets are told off by some of the integers (neighbours have 15 of 16
frames in common), the others are judged by the share of bits that differ over the overlap, so that excerpts match.

Defined results: a recording that is null or shorter than FILTER_FRAMES frames has no integers and matches nothing; rows
are kept one for one; rows with equal fingerprints form one class and match with no bit in error; a null id is no query
and never a best match's name if another row has an id; other columns are ignored; recordings are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import SLICE_BYTES, raw, staged, trim

RATE, FRAME, HOP = 8000, 512, 64
FILTER_FRAMES = 16
LOW_HZ, HIGH_HZ = 55.0, 3520.0
MOST_ERROR = 0.2
#: Items that an overlap should have (0.26 s), so that chance does not align unrelated recordings.
LEAST = 32
#: Offsets are first judged on every fourth (second) integer of a recording of 8 such steps or more, with so much more error.
STEPS, SLACK = (2, 4), 0.05
#: Frames that one spectrum pass holds, so that its arrays stay in a core's cache.
FRAMES = 128
#: Integers of queries that one pass holds, integers of other recordings that meet them at once, offsets judged at once.
QUERY_ITEMS, ROW_ITEMS, CELLS = 1 << 18, 1 << 20, 1 << 16
#: After so many sixteenths of its integers a block is looked through; if at most one in FEW offsets is left, only those go on.
STOPS, FEW = (9, 11, 13), 64
#: Places of two integers each that are judged at once; the first one's bits; the bits that count there with 0 to 8 integers left.
WORDS = np.arange(0, 8, 2)
LOW = np.uint64(0xFFFFFFFF)
MASKS = np.array([[(1 << 32 * min(2, max(0, n - w))) - 1 for w in WORDS.tolist()] for n in range(9)], np.uint64)

#: The filters by rule: shape, first pitch class, pitch classes and frames that each covers.
FILTERS = [(i % 6, (5 * i) % (13 - h), h, w) for i in range(16) for h, w in [((3, 4, 6, 9)[i % 4], (4, 8, 12, 16)[(i // 2) % 4])]]
#: Limits between a filter's four levels.
LEVELS = np.array([-0.06, 0.0, 0.06])
GRAY = np.array([0, 1, 3, 2], np.uint32)


def _pitch_classes(rate: int) -> np.ndarray:
    """Which pitch class each bin of the spectrum adds to, as a matrix."""
    hertz = np.fft.rfftfreq(FRAME, 1 / rate)
    out = np.zeros((len(hertz), 12), np.float32)
    inside = np.flatnonzero((hertz >= LOW_HZ) & (hertz <= HIGH_HZ))
    out[inside, (np.round(12 * np.log2(hertz[inside] / 440)).astype(int) + 9) % 12] = 1
    return out


def frames(samples: np.ndarray, starts: np.ndarray | None = None, rate: int = RATE) -> np.ndarray:
    """Pitch-class energies of the frames at `starts` (all of one recording), scaled to unit length."""
    starts = np.arange(0, max(0, len(samples) - FRAME + 1), HOP) if starts is None else starts
    out = np.zeros((len(starts), 12), np.float32)
    if not len(starts):
        return out
    to_class, shape = _pitch_classes(rate), np.hanning(FRAME).astype(np.float32)
    windows = np.lib.stride_tricks.sliding_window_view(samples, FRAME)
    for i in range(0, len(starts), FRAMES):
        part = windows[starts[i : i + FRAMES]].astype(np.float32)
        part -= part.mean(axis=1, keepdims=True)
        part *= shape
        spectrum = np.fft.rfft(part, axis=1).view(np.float32)
        np.multiply(spectrum, spectrum, out=spectrum)
        out[i : i + FRAMES] = (spectrum[:, ::2] + spectrum[:, 1::2]) @ to_class
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-2, out / np.maximum(norm, 1e-9), 0).astype(np.float32)


def fingerprint(chroma: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """The packed integers at frames `at` (all), from each of which FILTER_FRAMES frames of its recording remain."""
    at = np.arange(max(0, len(chroma) - FILTER_FRAMES + 1)) if at is None else at
    if not len(at):
        return np.zeros(0, np.uint32)
    image = np.zeros((len(chroma) + 1, 13))
    image[1:, 1:] = chroma.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)

    def area(t: int, y: int, w: int, h: int) -> np.ndarray:
        return image[at + t + w, y + h] - image[at + t, y + h] - image[at + t + w, y] + image[at + t, y]

    out = np.zeros(len(at), np.uint32)
    for shape, y, h, w in FILTERS:
        if shape == 0:  # everything against its share of all pitch classes
            a, whole = area(0, y, w, h), area(0, 0, w, 12)
            b = whole * h / 12
        elif shape == 1:  # lower against upper classes
            a, b = area(0, y, w, h // 2), area(0, y + h // 2, w, h - h // 2)
        elif shape == 2:  # earlier against later
            a, b = area(0, y, w // 2, h), area(w // 2, y, w - w // 2, h)
        elif shape == 3:  # quarters crosswise
            a = area(0, y, w // 2, h // 2) + area(w // 2, y + h // 2, w - w // 2, h - h // 2)
            b = area(0, y + h // 2, w // 2, h - h // 2) + area(w // 2, y, w - w // 2, h // 2)
        elif shape == 4:  # middle third of the classes against the rest
            a = area(0, y + h // 3, w, h - 2 * (h // 3))
            b = area(0, y, w, h) - a
        else:  # middle third of the time against the rest
            a = area(w // 3, y, w - 2 * (w // 3), h)
            b = area(0, y, w, h) - a
        out = out << np.uint32(2) | GRAY[np.searchsorted(LEVELS, np.round(np.log1p(np.maximum(a, 0)) - np.log1p(np.maximum(b, 0)), 7))]
    return out


def fingerprinted(samples: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frames of each recording, integers of all recordings end to end, their offsets), all recordings at once."""
    size = np.diff(offsets)
    n = np.where(size >= FRAME, (size - FRAME) // HOP + 1, 0)
    first = np.r_[0, np.cumsum(n)]
    within = np.arange(first[-1]) - np.repeat(first[:-1], n)
    chroma = frames(samples, np.repeat(offsets[:-1], n) + HOP * within)
    return n, fingerprint(chroma, np.flatnonzero(within + FILTER_FRAMES <= np.repeat(n, n))), np.r_[0, np.cumsum(np.maximum(n - FILTER_FRAMES + 1, 0))]


def needed(n_a: np.ndarray | int, n_b: np.ndarray | int) -> np.ndarray:
    """Items that an overlap should have: half of the shorter recording, and LEAST or else the whole longer one."""
    return np.maximum((np.minimum(n_a, n_b) + 1) // 2, np.minimum(np.maximum(n_a, n_b), LEAST))


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, float]:
    """(offset of b's begin in a, share of differing bits over the overlap) at the best of all offsets.

    Items that an overlap lacks of those needed() count as half wrong, as unrelated bits would. Every offset is tried:
    this is the definition that matched() is tested against.
    """
    need, best = int(needed(len(a), len(b))), (1.0, 0, 0)
    for off in range(1 - len(b), len(a)):
        begin, end = max(0, off), min(len(a), off + len(b))
        wrong = int(np.bitwise_count(a[begin:end] ^ b[begin - off : end - off]).sum())
        best = min(best, ((wrong + 16 * max(0, need - end + begin)) / (32 * max(need, end - begin)), abs(off), off))
    return best[2], best[0]


class Recordings:
    """Many recordings' integers end to end; those of like length also side by side, in columns by length."""

    def __init__(self, items: np.ndarray, offsets: np.ndarray):
        self.items, self.first, self.size = items, offsets[:-1], np.diff(offsets)
        nxt = np.r_[items[1:], np.zeros(1, np.uint32)]
        self.twos = items.astype(np.uint64) | nxt.astype(np.uint64) << np.uint64(32)
        order = np.argsort(self.size, kind="stable")
        like = (np.log(np.maximum(self.size[order], 1)) / np.log(1.2)).astype(int)
        self.groups = []
        for own in np.split(order, np.flatnonzero(np.diff(like)) + 1):
            wide = int(self.size[own].max(initial=0))
            table = np.zeros((3 * wide, len(own)), np.uint32)
            for column, r in enumerate(own):
                table[wide : wide + self.size[r], column] = items[self.first[r] : self.first[r] + self.size[r]]
            self.groups.append((own, wide, table))
        self._pairs: dict[tuple[int, int], np.ndarray] = {}

    def pairs(self, group: int, step: int) -> np.ndarray:
        """The integers of a group's table, each with the one `step` rows below in its upper half."""
        if (group, step) not in self._pairs:
            table = self.groups[group][2].astype(np.uint64)
            table[: max(0, len(table) - step)] |= table[step:] << np.uint64(32)
            self._pairs[group, step] = table
        return self._pairs[group, step]


def _judged(x: Recordings, y: Recordings, a: np.ndarray, b: np.ndarray, off: np.ndarray, most: float) -> tuple[np.ndarray, ...]:
    """(a, b, offset, error) of those alignments of recordings a of x and b of y that err in at most `most`; others stop early."""
    n_a, n_b = x.size[a], y.size[b]
    begin = np.maximum(0, off)
    over = np.minimum(n_a, off + n_b) - begin
    need = needed(n_a, n_b)
    whole = np.maximum(need, over)
    wrong = 16 * np.maximum(0, need - over)
    live = np.flatnonzero((over > 0) & (wrong <= 32 * most * whole))
    at_x, at_y = (x.first[a] + begin)[live], (y.first[b] + begin - off)[live]
    more, now, limit = over[live], wrong[live], 32 * most * whole[live]
    done = []
    while len(live):
        differ = x.twos.take(at_x[:, None] + WORDS, mode="clip") ^ y.twos.take(at_y[:, None] + WORDS, mode="clip")
        differ &= MASKS[np.minimum(more, len(MASKS) - 1)]
        now = now + np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
        good, ended = now <= limit, more < len(MASKS)
        hit = good & ended
        wrong[live[hit]] = now[hit]
        done.append(live[hit])
        on = np.flatnonzero(good & ~ended)
        live, now, limit = live[on], now[on], limit[on]
        at_x, at_y, more = at_x[on] + len(MASKS) - 1, at_y[on] + len(MASKS) - 1, more[on] - len(MASKS) + 1
    hit = np.concatenate(done) if done else np.zeros(0, np.int64)
    return a[hit], b[hit], off[hit], wrong[hit] / (32 * whole[hit])


def _near(x: Recordings, y: Recordings, most: float, equal: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, offset of a's begin in b) for a of x and longer (with `equal`, not shorter) b of y that every step-th integer lets pass."""
    for m in np.unique(x.size):
        same = np.flatnonzero(x.size == m)
        step = max((s for s in STEPS if 8 * s <= m), default=1)
        slack = SLACK if step > 1 else 1e-9
        at = np.arange(0, m, step)
        ones = np.bitwise_count(x.items[x.first[same][:, None] + at]).sum(axis=1)
        same = same[np.argsort(ones, kind="stable")]  # like sums of bits come together
        value = x.items[x.first[same][:, None] + at]
        bits = np.zeros((len(same), len(at) + 1), np.int32)
        np.cumsum(np.bitwise_count(value), axis=1, out=bits[:, 1:])
        twos = value[:, ::2].astype(np.uint64)
        twos[:, : len(at) // 2] |= value[:, 1::2].astype(np.uint64) << np.uint64(32)
        kind = np.uint16 if 64 * len(at) < 1 << 16 else np.uint32
        for g, (own, wide, _) in enumerate(y.groups):
            begin = int(np.searchsorted(y.size[own], m, "left" if equal else "right"))
            size = y.size[own[begin:]]
            shortest = _shortest(m, size, most)
            size = size[: np.searchsorted(shortest, m, "right")]  # no overlap is longer than m
            if not len(size):
                continue
            new = np.r_[True, size[1:] != size[:-1]]
            n, of = size[new], np.cumsum(new) - 1  # columns of one length have all limits in common
            need, columns = needed(m, n), len(size)
            off = np.arange(shortest[0] - m, n[-1] - shortest[0] + 1)
            over = np.minimum(m, n - off[:, None]) - np.maximum(0, -off)[:, None]
            low, high = (np.maximum(0, -off) + step - 1) // step, (np.clip(n - off[:, None], 0, m) + step - 1) // step
            rate = np.maximum(0, high - low[:, None]) / np.maximum(over, 1)
            limit = np.floor((32 * (most + slack) * np.maximum(need, over) - 16 * np.maximum(0, need - over)) * rate).astype(np.int32)
            limit[over <= 0] = -(1 << 30)
            # end to end, so that an offset's columns follow those of the offset before
            table = np.ascontiguousarray(y.pairs(g, step)[wide + off[0] : wide + off[-1] + at[-1] + 1, begin : begin + columns]).ravel()
            cells = len(off) * columns
            each = max(1, CELLS // cells)
            for i in range(0, len(same), each):
                own_bits = bits[i : i + each]
                # integers beside the column meet zeros; the most bits of any recording here come first, its own last
                bound = limit + (own_bits[:, -1:] - own_bits).max(axis=0)[high] + own_bits.max(axis=0)[low][:, None]
                bound = np.take((np.maximum(bound, -1) + 1).astype(kind), of, axis=1).ravel()
                p, cell, wrong = _under(table, columns * at[::2], twos[i : i + each], bound, len(at) % 2 == 1)
                o, c = np.divmod(cell, columns)
                u = of[c]
                good = wrong <= limit[o, u] + own_bits[p, -1] - own_bits[p, high[o, u]] + own_bits[p, low[o]]
                yield same[i + p[good]], own[begin + c[good]], off[o[good]]


def _shortest(m: int, n: np.ndarray, most: float) -> np.ndarray:
    """The shortest overlap of recordings of m and n integers whose charge alone is not too much."""
    return np.maximum(1, np.ceil((0.5 - most) * 2 * needed(m, n) - 1e-9)).astype(int)


def _under(table: np.ndarray, starts: np.ndarray, twos: np.ndarray, bound: np.ndarray, odd: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of `twos`, cell, bits) where the bits in which twos[row, k] and table[starts[k] + cell] differ, over all k, are fewer than bound[cell].

    With `odd` the last of `twos` is one integer. Sums only grow: once few cells are under their bound, only those are summed on.
    """
    n, cells = len(twos), len(bound)
    tall = n > cells  # the longer of the two lies in memory's order
    bound = bound[:, None] if tall else bound
    wrong = np.zeros((cells, n) if tall else (n, cells), bound.dtype)
    differ, some, count = (np.empty(wrong.shape, kind) for kind in (np.uint64, np.uint8, np.uint8))
    last = len(starts) - 1
    stops = {(last + 1) * s // 16 for s in STOPS} if last >= 7 else set()
    for k, start in enumerate(starts):
        theirs, ours = table[start : start + cells], twos[:, k]
        np.bitwise_xor(theirs[:, None] if tall else theirs, ours if tall else ours[:, None], out=differ)
        if odd and k == last:
            np.bitwise_and(differ, LOW, out=differ)
        if k % 3 == 0:  # three counts fit a byte
            np.bitwise_count(differ, out=some)
        else:
            np.bitwise_count(differ, out=count)
            np.add(some, count, out=some)
        if k % 3 == 2 or k == last or k + 1 in stops:
            np.add(wrong, some, out=wrong)
            some[:] = 0
        if k == last or k + 1 in stops:
            left = np.flatnonzero(wrong < bound)
            if FEW * len(left) <= wrong.size:
                break
    row, cell = (left % n, left // n) if tall else (left // cells, left % cells)
    wrong = wrong.ravel()[left].astype(np.int64)
    each = max(1, CELLS // max(1, len(left)))
    for i in range(k + 1, last + 1, each):
        rest = np.arange(i, min(last + 1, i + each))
        differ = table[starts[rest] + cell[:, None]] ^ twos[row[:, None], rest]
        if odd and rest[-1] == last:
            differ[:, -1] &= LOW
        wrong += np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
    return row, cell, wrong


def _batches(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], least: int = 1 << 15) -> Iterator[tuple[np.ndarray, ...]]:
    """Alignments gathered to about `least`, so that few steps judge many."""
    held, n = [], 0
    for part in found:
        if len(part[0]):
            held.append(part)
            n += len(part[0])
        if n >= least:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def matches(x: Recordings, y: Recordings, most: float) -> tuple[np.ndarray, ...]:
    """(a, b, offset, error): the best alignment of each pair of x and y that errs in at most `most`."""
    found = [_judged(x, y, a, b, -off, most) for a, b, off in _batches(_near(x, y, most, True))]
    found += [_judged(x, y, a, b, off, most) for b, a, off in _batches(_near(y, x, most, False))]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, b, off, error = (np.concatenate([f[i] for f in found]) for i in range(4))
    order = np.lexsort((off, np.abs(off), error, b, a))
    a, b, off, error = a[order], b[order], off[order], error[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    return a[new], b[new], off[new], error[new]


def fingerprints(recordings: DataFrame, id_col: str, audio_col: str) -> DataFrame:
    """(id, n_frames, items array<int>) of each row; audio: binary or string (its UTF-8 bytes) of unsigned 8-bit samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audio = batch.column(1).fill_null(b"")
            data, offsets = raw(audio.cast(pa.binary()))
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + SLICE_BYTES, "right")) - 1)
                n, items, ends = fingerprinted(data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(items.view(np.int32)))], names=["id", "n_frames", "items"])
                begin = end
        trim()

    return recordings.select(F.col(id_col).cast("long").alias("id"), F.col(audio_col).cast("binary").alias("audio")).mapInArrow(run, "id long, n_frames long, items array<int>")


def _flat(column: pa.Array | pa.ChunkedArray) -> Recordings:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    return Recordings(column.flatten().to_numpy().view(np.uint32), np.r_[0, np.cumsum(size)].astype(np.int64))


def _against(asked: pa.Table, most: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches (class, items) to their matches (a, b, offset, error) with the queries a."""
    held = asked.column(1).combine_chunks()
    name, flat, sizes = asked.column(0).to_numpy(), held.flatten().to_numpy().view(np.uint32), held.value_lengths().to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = None
        for batch in batches:
            if not batch.num_rows:
                continue
            queries = queries or Recordings(flat, np.r_[0, np.cumsum(sizes)].astype(np.int64))
            ends = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + ROW_ITEMS, "right")))
                part = batch.slice(begin, end - begin)
                begin = end
                a, b, off, error = matches(queries, _flat(part.column(1)), most)
                left, right = name[a], part.column(0).to_numpy()[b]
                other = left != right
                yield pa.RecordBatch.from_arrays([pa.array(left[other]), pa.array(right[other]), pa.array(off[other]), pa.array(error[other])], names=["a", "b", "offset", "error"])
        trim()

    return run


def matched(recordings: DataFrame, id_col: str = "page_id", audio_col: str = "html", step: int = 50, most_error: float = MOST_ERROR) -> DataFrame:
    """(id, n_frames, n_items, fingerprint_sha256, is_query, n_matches, best_id, best_offset, best_error) for each row.

    Rows whose id `step` divides are queries against all rows: n_matches other rows align with at most `most_error` of
    their bits wrong; the best of another fingerprint is named by its class's least id. The last four are null for other rows.
    """
    rows = staged(fingerprints(recordings, id_col, audio_col).withColumn("class", F.xxhash64("items")), "fingerprints")
    query = F.coalesce(F.col("id") % step == 0, F.lit(False))
    classes = staged(rows.where(F.size("items") > 0).groupBy("class").agg(F.first("items").alias("items"), F.min("id").alias("least"), F.count("*").alias("copies"), F.bool_or(query).alias("asked")), "classes")
    n_items = classes.where("asked").agg(F.sum(F.size("items"))).first()[0] or 0
    blocks = -(-n_items // QUERY_ITEMS)
    judged = None
    for k in range(blocks):  # each block of queries goes to every task, so that no key is dealt and none is hot
        asked_here = classes.where("asked").where(F.pmod(F.hash("class"), F.lit(blocks)) == k).select("class", "items").toArrow()
        more = staged(classes.select("class", "items").mapInArrow(_against(asked_here, most_error), "a long, b long, offset long, error double"), "matches")
        judged = more if judged is None else judged.union(more)
    if judged is None:
        judged = recordings.sparkSession.createDataFrame([], "a long, b long, offset long, error double")
    named = judged.join(classes.select(F.col("class").alias("b"), "least", "copies"), "b")
    best = named.groupBy("a").agg(F.sum("copies").alias("others"), F.min_by(F.struct("least", "offset", "error"), F.struct("error", "least", "b")).alias("best")).withColumnRenamed("a", "class")
    found = classes.where("asked").select("class", "copies").join(best, "class", "left")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha = [hashlib.sha256(np.array(x, "<i4").tobytes()).hexdigest() for x in batch.column(2).to_pylist()]
            sizes = pa.array([len(x) for x in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, pa.array(sha, pa.string()), batch.column(3)], names=["id", "n_frames", "n_items", "fingerprint_sha256", "class"])

    told = rows.select("id", "n_frames", "items", "class").mapInArrow(digest, "id long, n_frames long, n_items long, fingerprint_sha256 string, class long")
    out = told.withColumn("is_query", query).join(found, "class", "left")
    asked = lambda c: F.when(F.col("is_query"), c)
    return out.select(
        F.col("id").alias(id_col), "n_frames", "n_items", "fingerprint_sha256", "is_query",
        asked(F.coalesce("others", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_matches"),
        asked(F.col("best.least")).alias("best_id"), asked(F.col("best.offset")).alias("best_offset"), asked(F.col("best.error")).alias("best_error"),
    )
