"""Near-duplicate documents by min-max hashing over word shingles, links confirmed on the full sets.

Under each permutation both the least and the greatest value are kept, so that half the hash evaluations give a
signature of the usual length. Documents with equal shingle sets form one class; only classes meet. Bands of the
signature name buckets. First each class is compared with the head that most of its buckets name, which joins large
groups by as many pairs as they have classes. In buckets that still hold several components, all classes outside the
bucket's main component are then compared with all others, block by block: by sketches first, then on full sets in the
task itself, which gives a spanning forest of the links found, so that no stage gives rows for pairs.

Defined results: a document without words (null and empty texts too) has no shingles and links with nothing; fewer
words than a shingle make one shingle of them all; rows are kept one for one; rows that repeat an id share its
component, and `kept` holds for each of them; a null id takes part in links, is never a component's name, and is kept only if
its row is linked with nothing (then component_id is null); other columns are ignored, whatever their names; very long
texts are read whole; no rows give no rows. one_of_each() decides by row: of equal rows that have words one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import by_key, column, components, fresh, mix, raw, row_key, slices, staged, strings
from clausewise.llm.words import word_hashes

WORDS = 5
#: At a similarity of 0.75 a pair shares no band with a probability of (1 - 0.75**5)**38 < 0.00004.
PERMUTATIONS, BAND, BANDED = 190, 5, 190
#: Bucket pairs whose signatures of 380 values agree in a smaller share are no candidates: at a similarity of 0.75 the
#: share is 3.8 standard errors higher, so a pair is lost with a probability below 0.0001.
SKETCH_LEAST = 0.665
#: Bytes of each band's key kept behind the sketch's values: that a band seems shared and is not, in its values' low bytes
#: and in its key's, has a probability of about 2**-16 times that of the low bytes alone.
TAG = 2
#: Classes and shingles of a block, about.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
PER_CENT = 75
#: What has no word, as a pattern.
BLANK = r"^[\x20\x09-\x0D]*$"

_rng = np.random.default_rng(20240501)
_MULTIPLY = _rng.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64)


def shingle_sets(text: pa.StringArray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, end to end, and their offsets."""
    data, offsets = raw(text)
    hashes, doc = word_hashes(data, offsets)
    n = len(text)
    size = np.bincount(doc, minlength=n)
    first = np.r_[0, np.cumsum(size)][:-1]
    place = np.arange(len(hashes)) - first[doc]
    length = np.minimum(size, words)
    start = place <= (size - length)[doc]
    at = np.flatnonzero(start)
    value = np.zeros(len(at), np.uint64)
    last = len(hashes) - 1
    for k in range(words):
        inside = k < length[doc[at]]
        value = np.where(inside, mix(value + hashes[np.minimum(at + k, last)] * np.uint64(2 * k + 3)), value) if len(at) else value
    value, owner = mix(value), doc[at]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.r_[0, np.cumsum(np.bincount(owner, minlength=n))].astype(np.int64)


def min_max(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The signature of each set, a row of 2 x PERMUTATIONS values, of which bands use the first BANDED; sets must not be empty."""
    out = np.empty((len(offsets) - 1, 2 * PERMUTATIONS), np.uint32)
    for p in range(PERMUTATIONS):
        hashed = ((values * _MULTIPLY[p] + _ADD[p]) >> np.uint64(32)).astype(np.uint32)
        out[:, 2 * p] = np.minimum.reduceat(hashed, offsets[:-1])
        out[:, 2 * p + 1] = np.maximum.reduceat(hashed, offsets[:-1])
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """docs (key columns, then text) without text, with n, low, high, bands, sketch; low and high are a 128-bit digest of the set, 0 if empty."""
    keys = docs.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, text in slices(batches):
            values, offsets = shingle_sets(text)
            n = np.diff(offsets)
            low, high = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            full = np.flatnonzero(n)
            bands = np.zeros((len(n), 0), np.int64)
            sketch = np.zeros((len(n), 2 * PERMUTATIONS + TAG * (BANDED // BAND)), np.uint8)
            counts = np.where(n > 0, BANDED // BAND, 0)
            if len(full):
                heads = np.r_[offsets[:-1][full], offsets[-1]]
                low[full] = np.add.reduceat(mix(values + np.uint64(1)), heads[:-1])
                high[full] = np.add.reduceat(mix(values ^ np.uint64(0x5DEECE66D)), heads[:-1])
                signature = min_max(values, heads)
                sketch[full, : 2 * PERMUTATIONS] = signature.astype(np.uint8)
                key = np.zeros((len(full), BANDED // BAND), np.uint64)
                for k in range(BAND):
                    key = mix(key * np.uint64(31) + signature[:, k:BANDED:BAND].astype(np.uint64) + np.uint64(k))
                bands = mix(key + np.arange(key.shape[1], dtype=np.uint64)).view(np.int64)
                sketch[full, 2 * PERMUTATIONS :] = (bands & 0xFFFF).astype("<u2").view(np.uint8)
            ends = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(i) for i in range(len(keys))), pa.array(n.astype(np.int64)), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(bands.reshape(-1))), pa.array([x.tobytes() for x in sketch], pa.binary())],
                names=[*keys, "n", "low", "high", "bands", "sketch"],
            )

    return docs.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in docs.dtypes[:-1]) + ", n long, low long, high long, bands array<long>, sketch binary")


def confirmed(pairs: DataFrame, texts: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= per_cent * union of the full sets; texts: (node, text), node unique.

    Both texts come by joins on their node, which Spark can split where one node has many pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, right in slices(batches, "text_b", 1 << 20):
            left = strings(rows.column(2)).dictionary_encode()
            value_a, off_a = shingle_sets(left.dictionary)
            value_b, off_b = shingle_sets(right)
            good = np.zeros(rows.num_rows, bool)
            for i, k in enumerate(left.indices.to_pylist()):
                x, y = value_a[off_a[k] : off_a[k + 1]], value_b[off_b[i] : off_b[i + 1]]
                at = np.minimum(np.searchsorted(x, y), len(x) - 1) if len(x) else np.zeros(0, np.int64)
                both = int((x[at] == y).sum()) if len(x) else 0
                good[i] = both > 0 and 100 * both >= per_cent * (len(x) + len(y) - both)
            yield rows.filter(pa.array(good)).select([0, 1])

    needed = texts.join(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "node", "left_semi")
    joined = pairs.join(needed.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(needed.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _units(placed: DataFrame) -> DataFrame:
    """(key, t, asks, minor, node, n, component): the buckets of several components, dealt to units of work.

    placed: (band, t, node, n, component). The classes outside a bucket's main component ask; they and all classes of
    the bucket are dealt to blocks by hash, and each block that asks meets each block of all in one unit.
    """
    held = placed.groupBy("band", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    blocks = lambda c, s: F.ceil(F.greatest(c / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    order = F.struct("c", "component")
    held = held.groupBy("band").agg(F.count("*").alias("several"), F.max(order).alias("top"), F.max_by("s", order).alias("top_s"), F.sum("c").alias("c"), F.sum("s").alias("s")).where("several > 1")
    held = held.select("band", F.col("top.component").alias("main"), blocks(F.col("c") - F.col("top.c"), F.col("s") - F.col("top_s")).alias("ask"), blocks(F.col("c"), F.col("s")).alias("all"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(n)).cast("int")
    dealt = placed.join(held, "band").withColumn("minor", F.col("component") != F.col("main"))
    asked = F.transform(upto("ask"), lambda i: F.struct(i.alias("i"), own("all", 1).alias("j"), F.lit(False).alias("asks")))
    asking = F.transform(upto("all"), lambda j: F.struct(own("ask", 2).alias("i"), j.alias("j"), F.lit(True).alias("asks")))
    dealt = dealt.withColumn("unit", F.explode(F.when(F.col("minor"), F.concat(asked, asking)).otherwise(asked)))
    return dealt.select(F.xxhash64("band", "unit.i", "unit.j").alias("key"), "t", F.col("unit.asks").alias("asks"), "minor", "node", "n", "component")


_UNIT = "key long, t int, asks boolean, minor boolean, node long, n long, component long, sketch binary"


def _each(table: pa.Table) -> Iterator[tuple[int, int]]:
    """The ranges of rows of one unit (key and place of the band)."""
    key, t = table.column(0).to_numpy(), table.column(1).to_numpy()
    cuts = np.r_[np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (t[1:] != t[:-1])]), len(key)]
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def _candidates(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that ask, rows asked, whether each pair's sketches agree in enough places) of one unit.

    A pair with several bands in common counts in the first of them only, as the sketches tell, which hold a byte of
    each value and TAG bytes of each band's key.
    """
    t = int(table.column(1)[0].as_py())
    asks, minor, node, n, component = (table.column(i).to_numpy(zero_copy_only=False) if i < 4 else table.column(i).to_numpy() for i in (2, 3, 4, 5, 6))
    x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
    if not len(x) or not len(y):
        return x, y, np.zeros((len(x), len(y)), bool)
    held = table.column(7).to_pylist()
    sketch = np.frombuffer(b"".join(held), np.uint8).reshape(len(held), -1)
    good = component[x][:, None] != component[y][None]
    good &= ~(minor[y][None] & (node[x][:, None] > node[y][None]))  # two that ask meet once
    good &= 100 * np.minimum(n[x][:, None], n[y][None]) >= PER_CENT * np.maximum(n[x][:, None], n[y][None])
    for i in range(0, len(x), 16):
        own = np.flatnonzero(good[i : i + 16].any(axis=0))
        if len(own):
            equal = sketch[x[i : i + 16]][:, None, :] == sketch[y[own]][None]
            bands = equal[:, :, :BANDED].reshape(*equal.shape[:2], BANDED // BAND, BAND).all(axis=3)
            bands &= equal[:, :, 2 * PERMUTATIONS :].reshape(*bands.shape, TAG).all(axis=3)
            good[i : i + 16, own] &= (equal[:, :, : 2 * PERMUTATIONS].sum(axis=2) >= SKETCH_LEAST * 2 * PERMUTATIONS) & (bands.argmax(axis=2) == t) & bands[:, :, t]
    return x, y, good


def _involved(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows of units that are a candidate's."""
    table = table.combine_chunks()
    keep = np.zeros(table.num_rows, bool)
    for a, b in _each(table):
        x, y, good = _candidates(table.slice(a, b - a).combine_chunks())
        keep[a + x[good.any(axis=1)]] = True
        keep[a + y[good.any(axis=0)]] = True
    yield from table.filter(pa.array(keep)).to_batches()


def _linked(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """(a, b): a spanning forest of the components that are linked within each unit, candidates compared on full sets."""
    table = table.combine_chunks()
    found: list[tuple[int, int]] = []
    for a, b in _each(table):
        unit = table.slice(a, b - a).combine_chunks()
        x, y, good = _candidates(unit)
        x, good = x[good.any(axis=1)], good[good.any(axis=1)]
        if not len(x):
            continue
        names, root = np.unique(unit.column(6).to_numpy(), return_inverse=True)
        values, offsets = shingle_sets(strings(unit.column(8)))
        _, code = np.unique(values, return_inverse=True)
        size = np.diff(offsets)
        mark = np.zeros(int(code.max(initial=0)) + 1, bool)
        for i, row in enumerate(x):
            ask = y[good[i] & (root[y] != root[row])]
            if not len(ask):
                continue
            own = code[offsets[row] : offsets[row + 1]]
            mark[own] = True
            ends = np.cumsum(size[ask])
            take = np.arange(ends[-1]) + np.repeat(offsets[ask] - np.r_[0, ends[:-1]], size[ask])
            both = np.add.reduceat(mark[code[take]].astype(np.int64), np.r_[0, ends[:-1]])
            mark[own] = False
            for other in np.unique(root[ask[100 * both >= PER_CENT * (size[ask] + size[row] - both)]]).tolist():
                mine = int(root[row])
                if other != mine:
                    found.append((int(names[mine]), int(names[other])))
                    root[root == max(mine, other)] = min(mine, other)
    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])


def grouped(docs: DataFrame) -> DataFrame:
    """docs (key columns, then text) without text, with n and `c`, a name of the row's component (null without words).

    Every pair of classes that shares a bucket is compared on full sets, unless both are in one component by then, or
    their sketches or sizes differ too far. A class is named by a row number, so no two classes are taken for one.
    """
    keyed = docs.withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))
    signed = staged(signatures(keyed.select(*docs.columns[:-1], "digest", "text")).withColumn("row", F.monotonically_increasing_id()), "signatures")
    classes = staged(signed.where("n > 0").groupBy("low", "high").agg(F.min("row").alias("node"), F.min("digest").alias("digest"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    entries = classes.select("node", "n", F.posexplode("bands").alias("t", "band"))
    shared = entries.groupBy("band").agg(F.count("*").alias("size"), F.min(F.struct("node", "n")).alias("head")).where("size > 1").select("band", F.col("head.node").alias("head"), F.col("head.n").alias("head_n"))
    entries = staged(entries.join(shared, "band"), "buckets")
    # one text for each class that shares a bucket
    chosen = classes.join(entries.select("node").distinct(), "node", "left_semi").select("digest", "node")
    texts = staged(keyed.select("digest", "text").join(chosen, "digest").groupBy("node").agg(F.first("text").alias("text")), "texts")
    # each class against the head that most of its buckets name
    alike = f"node <> head and 100 * least(n, head_n) >= {PER_CENT} * greatest(n, head_n)"
    most = entries.where(alike).groupBy("node", "head").agg(F.count("*").alias("c")).groupBy("node").agg(F.max_by("head", F.struct("c", "head")).alias("head"))
    first = components(confirmed(most.select(F.col("head").alias("a"), F.col("node").alias("b")), texts))
    # all others across the components of each bucket
    placed = entries.join(first, "node", "left").select("band", "t", "node", "n", F.coalesce("component", "node").alias("component"))
    rows = _units(placed).join(classes.select("node", "sketch"), "node").select(*(c.split(" ")[0] for c in _UNIT.split(", ")))
    dealt = lambda df, work: df.repartition("key").sortWithinPartitions("key", "t").mapInArrow(lambda batches: by_key(batches, work, 2 * BLOCK, 1 << 24), _UNIT if work is _involved else "a long, b long")
    met = staged(dealt(rows, _involved), "units")
    second = components(dealt(met.join(texts, "node").select(*rows.columns, "text"), _linked))
    named = signed.where("n > 0").join(classes.select("low", "high", "node"), ["low", "high"]).select(*docs.columns[:-1], "n", "node").join(first, "node", "left")
    named = named.withColumn("c", F.coalesce("component", "node")).drop("component", "node").join(second.select(F.col("node").alias("c"), F.col("component").alias("joined")), "c", "left")
    named = named.select(*docs.columns[:-1], "n", F.coalesce("joined", "c").alias("c"))
    return named.union(signed.where("n = 0").select(*docs.columns[:-1], "n", F.lit(None).cast("long").alias("c")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row."""
    placed = staged(grouped(docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))), "placed")
    smallest = placed.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")).where("size > 1").select("c", "least")
    out = placed.join(smallest, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull() & F.col("component_id").isNull())
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, of which one of each component stays: that of the least id (nulls last).

    Rows are told apart by a key of 128 bits over all their columns; of rows that are equal in all columns and have
    words one stays, also where nothing else is linked with them. Rows without words all stay.
    """
    text = column(docs, text_col)
    one, two = fresh("row_low", docs), fresh("row_high", docs)
    keyed = docs.withColumns({one: row_key(docs, 1), two: row_key(docs, 2)})
    wordless = F.coalesce(text.rlike(BLANK), F.lit(True))
    placed = grouped(docs.select(column(docs, id_col).cast("long").alias("doc_id"), row_key(docs, 1).alias("k1"), row_key(docs, 2).alias("k2"), text.alias("text")))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")
    winners = placed.where("c is not null").groupBy("c").agg(F.min(order).alias("least")).select(F.col("least.k1").alias(one), F.col("least.k2").alias(two))
    return keyed.where(~wordless).dropDuplicates([one, two]).join(winners, [one, two], "left_semi").select(*(f"`{c}`" for c in docs.columns)).union(docs.where(wordless))
