"""Helpers shared by the operators: shared-folder tables, text batches, array hashing, components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that an operator's arrays cover at once, so that a worker's memory does not follow the batch size.
SLICE_BYTES = 1 << 20
_STAGED: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local one, but only for a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = tempfile.mkdtemp(prefix="clausewise-")
    spark.sparkContext.setCheckpointDir(found)
    return found


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def marked() -> int:
    """How many staged tables there are: release() may delete those before a mark."""
    return len(_STAGED)


def release(begin: int = 0, end: int | None = None) -> None:
    """Delete the staged tables between two marks (all of them); results that still read them must have been written before."""
    gone, _STAGED[begin:end] = _STAGED[begin:end], []
    for spark, path in gone:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            continue


atexit.register(release)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def strings(column: pa.Array | pa.ChunkedArray) -> pa.StringArray:
    """A plain string array in which nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def raw(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its offsets, the first of which is 0."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def trim() -> None:
    """Give freed memory back at a task's end: workers live on, and several share one executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # no such call in this C library
        return


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.StringArray]]:
    """Cut batches into runs of whole rows of about `limit` bytes of text; one row may be longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = strings(batch.column(batch.schema.get_field_index(column)))
        _, offsets = raw(text)
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1)
            yield batch.slice(begin, end - begin), text.slice(begin, end - begin)
            begin = end
    trim()


def _parts(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most `rows` rows and about `size` bytes."""
    step = max(1, min(rows, size * batch.num_rows // max(batch.nbytes, 1)))
    for begin in range(0, batch.num_rows, step):
        yield batch.slice(begin, step)


def by_key(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table], Iterator[pa.RecordBatch]], least: int = 1 << 16, limit: int = 1 << 25) -> Iterator[pa.RecordBatch]:
    """Call work on runs of rows sorted by their first column that end where that column changes.

    A run has about `least` rows or `limit` bytes, or one key's rows where those are more, however many rows a batch has;
    each row is joined once.
    """
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in (part for whole in batches for part in _parts(whole, least, limit)):
        held.append(batch)
        rows += batch.num_rows
        size += batch.nbytes
        if rows >= least or size >= limit:
            key = batch.column(0)
            if held[0].column(0)[0] == key[len(key) - 1]:
                continue  # one key so far: nothing to cut
            key = key.to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))
            # where the last key begins in the batches before, they are cut instead
            at = len(held) - 1
            while cut == 0:
                at -= 1
                before = held[at].column(0).to_numpy()
                cut = int(np.searchsorted(before, key[-1], "left"))
                if cut == len(before):
                    at, cut = at + 1, 0
                    break
            yield from work(pa.Table.from_batches([*held[:at], held[at].slice(0, cut)]))
            held = [held[at].slice(cut), *held[at + 1 :]]
            rows, size = sum(x.num_rows for x in held), sum(x.nbytes for x in held)
    if held:
        yield from work(pa.Table.from_batches(held))
    del held
    trim()


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name like `name` that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(df: DataFrame, name: str) -> F.Column:
    """A column by its exact name, dots and blanks included."""
    return df["`" + name.replace("`", "``") + "`"]


def row_key(df: DataFrame, seed: int) -> F.Column:
    """A 64-bit hash of all columns of a row; two seeds make a key of 128 bits."""
    return F.xxhash64(F.lit(seed), *(F.to_json(F.struct(column(df, f.name))) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else column(df, f.name) for f in df.schema.fields))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift) over an array."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: A random-looking 64-bit value for each byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Base and inverse base to the powers 0 to n - 1, modulo 2**64; kept up to 4 million entries."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for base in (_BASE, _INVERSE):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            made.append(np.multiply.accumulate(out))
        if size > 1 << 22:
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


class Prefixes:
    """Polynomial prefix sums of a byte array: hash(a, b) of any range in constant time, equal for equal bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=self.sums[1:])

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        length = (b - a).astype(np.uint64)
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + length * np.uint64(0xC2B2AE3D27D4EB4F))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest (u, v), u > v, of the pairs of a partition, in runs of bounded size."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def flush() -> pa.RecordBatch:
        nodes = [n for n in parent if find(n) != n]
        out = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(n) for n in nodes], pa.int64())], names=["u", "v"])
        parent.clear()
        return out

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if x != y:
                x, y = find(x), find(y)
                parent[max(x, y)] = min(x, y)
        if len(parent) > 500_000:
            yield flush()
    if parent:
        yield flush()


def _small_star(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows (u, v, moved), sorted by u and v: every smaller neighbour of u, and u itself, is tied to the least of them."""
    u, v, moved = (table.column(i).to_numpy() for i in range(3))
    first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
    least = np.repeat(v[first], np.diff(np.r_[first, len(u)]))
    more = v != least
    pairs = np.unique(np.stack([v[more], least[more]]), axis=1) if more.any() else np.zeros((2, 0), np.int64)
    changed = np.logical_or.reduceat(moved | more, first)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.r_[u[first], pairs[0]]), pa.array(np.r_[v[first], pairs[1]]), pa.array(np.r_[changed, np.ones(pairs.shape[1], bool)])], names=["u", "v", "moved"]
    )


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that is reachable, for every node on an edge.

    Each partition first keeps a spanning forest of its own edges; then large-star steps (a join on the greater star's
    centre, which Spark can split) and small-star steps alternate until no edge moves. A node meets in one task only its
    smaller neighbours, of which a slice of a partition gives one.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    tree = staged(pairs.mapInArrow(_forest, "u long, v long"), "forest")
    for _ in range(rounds):
        centre = tree.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = tree.select("u", "v").join(centre, "v", "left").select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved"))
        small = large.repartition("u").sortWithinPartitions("u", "v").mapInArrow(lambda batches: by_key(batches, _small_star), "u long, v long, moved boolean")
        tree = staged(small, "stars")
        if not tree.agg(F.max("moved")).first()[0]:
            break
    else:
        raise RuntimeError("components did not settle")
    # settled: every node other than a root has one edge, to its root
    return tree.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tree.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
