"""Near-duplicate vectors by NN-descent, and their links at a cosine threshold.

Equal vectors form one class. Neighbour lists start from sign-of-projection tables, whose rows are compared in windows
of the sorted order; then neighbours of neighbours are joined until lists stop changing. Full lists do not hide a link:
each block of vectors also gives a spanning forest of its links, and large codes of the tables are compared whole across
the components found so far. Vectors whose lists hold linked neighbours are enlarged: their whole component is compared block by block, which counts every link in it.
The recall of links is audited against brute force for every vector whose id a step divides (recall()).

Defined results: vectors that are null, empty or zero, or hold a null or non-finite component, link with nothing, and so
do those of another length than most have; rows are kept one for one; rows that repeat an id share a component when they
link; a null id links but never names a component (its component is null where all its ids are); other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausewise.llm.common import by_key, components, staged

NEIGHBOURS = 16
WINDOW = 128
BLOCK = 1024
MISS = 0.01  # chance that the tables alone miss a pair at the threshold
_NEAR = 1e-6  # single-precision products are settled again in double precision


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Binary doubles as rows."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, node, unit) of each row: the vector over its norm as doubles, and a hash that names its class; null if it links with nothing."""
    lengths = vectors.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("n")).agg(F.count("*").alias("c"))
    most = lengths.orderBy(F.desc("c"), F.desc("n")).first()
    size = most.n if most else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            units = []
            for v in rows.column(1).to_pylist():
                x = np.array([np.nan if c is None else c for c in v], np.float64) if v is not None and len(v) == size and size else np.zeros(1)
                # components are scaled first, so that no square overflows
                top = np.abs(x).max() if np.isfinite(x).all() else 0.0
                x = x / top if top else x
                units.append((x / np.sqrt((x * x).sum())).tobytes() if top else None)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(units, pa.binary())], names=["id", "unit"])

    made = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>")).mapInArrow(run, "id long, unit binary")
    return made.select("id", F.when(F.col("unit").isNotNull(), F.xxhash64("unit")).alias("node"), "unit")


def _nearest(node: np.ndarray, unit: np.ndarray, floor: float, linked: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a, b, cosine): each one's k nearest at `floor` or above, and a spanning forest of all links."""
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, -2)
    cosine[node[:, None] == node[None, :]] = -2
    n = len(node)
    keep = np.zeros((n, n), bool)
    if n > k:
        top = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        keep[np.arange(n)[:, None], top] = True
    else:
        keep[:] = True
    keep &= cosine >= floor
    link = cosine >= linked + _NEAR
    keep |= (cosine >= linked - _NEAR) & ~link  # double precision decides, so that no forest rests on these
    if (link & ~keep & ~keep.T).any():
        left = link.any(axis=1)
        while left.any():
            front = [int(left.argmax())]
            left[front] = False
            for x in front:
                reached = np.flatnonzero(link[x] & left)
                keep[x, reached] = True
                left[reached] = False
                front.extend(reached.tolist())
    a, b = np.nonzero(keep)
    return node[a], node[b], cosine[a, b]


def _emitted(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if found:
        a, b, c = (np.concatenate([f[i] for f in found]) for i in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c.astype(np.float64))], names=["a", "b", "cosine"])


def _coded(classes: DataFrame, count: int, size: int, linked: float, units: bool) -> DataFrame:
    """(table, code, node) of each vector in each projection table, and its unit in single precision if asked for."""
    bits = max(1, min(40, round(math.log2(max(2, count / (WINDOW / 2))))))
    same = (1 - math.acos(linked) / math.pi) ** bits
    tables = max(4, math.ceil(math.log(MISS) / math.log(1 - same)))
    planes = np.random.default_rng(11).normal(size=(size, tables * bits)).astype(np.float32)
    weight = 1 << np.arange(bits, dtype=np.int64)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                unit = _matrix(rows.column(1)).astype(np.float32)
                code = ((unit @ planes > 0).reshape(len(unit), tables, bits) * weight).sum(axis=2)
                single = [pa.array([u.tobytes() for u in unit], pa.binary())] if units else []
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), t, np.int32)), pa.array(code[:, t]), rows.column(0), *single], names=["table", "code", "node", "unit"][: 3 + units])

    return classes.select("node", "unit").mapInArrow(codes, "table int, code long, node long" + ", unit binary" * units)


def _first_lists(classes: DataFrame, count: int, size: int, linked: float, floor: float, k: int) -> DataFrame:
    """(a, b, cosine) of neighbours in windows of WINDOW rows of each projection table's sorted order."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, node, unit = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, size), np.float32)
        for rows in batches:
            if not rows.num_rows:
                continue
            table = np.r_[table, rows.column(0).to_numpy()]
            node = np.r_[node, rows.column(2).to_numpy()]
            unit = np.concatenate([unit, np.frombuffer(b"".join(rows.column(3).to_pylist()), np.float32).reshape(-1, size)])
            at, found = 0, []
            while len(node) - at >= WINDOW:
                found += compare(table[at : at + WINDOW], node[at : at + WINDOW], unit[at : at + WINDOW])
                at += WINDOW // 2
            yield from _emitted(found)
            table, node, unit = table[at:], node[at:], unit[at:]
        yield from _emitted(compare(table, node, unit))

    def compare(table: np.ndarray, node: np.ndarray, unit: np.ndarray) -> list:
        return [_nearest(node[table == t], unit[table == t], floor, linked, k) for t in np.unique(table)]

    # the order ends with the node, so a code that many vectors share is dealt to several partitions
    rows = _coded(classes, count, size, linked, True)
    return rows.repartitionByRange("table", "code", "node").sortWithinPartitions("table", "code", "node").mapInArrow(windows, "a long, b long, cosine double")


def _lists(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each vector."""
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    return pairs.groupBy("a", "b").agg(F.max("cosine").alias("cosine")).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")


def _joined(lists: DataFrame, classes: DataFrame, linked: float, floor: float, k: int) -> DataFrame:
    """(a, b, cosine) of neighbours of neighbours: in the list of each vector, and in the lists that it is in.

    What points at one vector is dealt in parts of about 4 * k, each joined with its whole forward list.
    """
    pointing = lists.groupBy("b").agg(F.count("*").alias("n")).select(F.col("b").alias("hub"), F.ceil(F.col("n") / (4 * k)).cast("int").alias("parts"))
    forward = lists.select(F.col("a").alias("hub"), F.col("b").alias("member")).join(pointing, "hub", "left").select("hub", "member", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    backward = lists.select(F.col("b").alias("hub"), F.col("a").alias("member")).join(pointing, "hub").select("hub", "member", F.pmod(F.hash("member"), "parts").alias("part"))
    own = forward.select("hub", F.col("hub").alias("member"), "part").distinct()
    members = forward.union(backward).union(own).distinct().select(F.xxhash64("hub", "part").alias("key"), "member")
    rows = members.join(classes.select(F.col("node").alias("member"), "unit"), "member").select("key", "member", "unit")

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, node, unit = table.column(0).to_numpy(), table.column(1).to_numpy(), _matrix(table.column(2))
        cuts = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
        yield from _emitted([_nearest(node[x:y], unit[x:y], floor, linked, k) for x, y in zip(cuts[:-1], cuts[1:], strict=True) if y - x > 1])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: by_key(batches, work, 4096), "a long, b long, cosine double")


def _settled(pairs: DataFrame, classes: DataFrame, linked: float) -> DataFrame:
    """The pairs whose cosine in double precision reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                good = np.einsum("ij,ij->i", _matrix(rows.column(2)), _matrix(rows.column(3))) >= linked
                yield rows.filter(pa.array(good)).select([0, 1])

    near = pairs.where(F.col("cosine") >= linked - 2 * _NEAR).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, right = classes.select(F.col("node").alias("a"), F.col("unit").alias("x")), classes.select(F.col("node").alias("b"), F.col("unit").alias("y"))
    return near.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _across(coded: DataFrame, classes: DataFrame, member: DataFrame, linked: float) -> DataFrame:
    """(a, b, cosine): a link of each two components that have one in a block of a projection table's code.

    Codes of at most WINDOW / 2 vectors were compared whole by windows. The vectors of the others are dealt to blocks of
    about BLOCK by hash, and each pair of blocks is one unit of work, without the pairs inside a component.
    """
    placed = coded.join(member, "node", "left").select("table", "code", "node", F.coalesce("component", "node").alias("component"))
    sizes = placed.groupBy("table", "code").agg(F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y")).where(f"n > {WINDOW // 2} and x <> y")
    sizes = sizes.select("table", "code", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = placed.join(sizes, ["table", "code"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("table", "code", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node", "component")
    rows = dealt.join(classes.select("node", "unit"), "node").select("key", "node", "component", "unit")

    def compare(node: np.ndarray, component: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cosine = unit @ unit.T
        x, y = np.nonzero(np.triu((cosine >= linked - _NEAR) & (component[:, None] != component[None]), 1))
        c = cosine[x, y]
        low, high = np.minimum(component[x], component[y]), np.maximum(component[x], component[y])
        order = np.lexsort((-c, high, low))
        low, high = low[order], high[order]
        first = np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])] if len(order) else np.zeros(0, bool)
        order = order[first | (c[order] < linked + _NEAR)]
        return node[x[order]], node[y[order]], c[order]

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, node, component, unit = *(table.column(i).to_numpy() for i in range(3)), _matrix(table.column(3))
        cuts = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
        yield from _emitted([compare(node[x:y], component[x:y], unit[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True) if (component[x:y] != component[x]).any()])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: by_key(batches, work, 2 * BLOCK), "a long, b long, cosine double")


def _enlarged(placed: DataFrame, linked: float) -> DataFrame:
    """(node, links): for each vector of a component (component, node, unit, copies), the rows linked with it there.

    Members are dealt to blocks of about BLOCK by hash; each pair of blocks is one unit of work that gives counts only.
    """
    sizes = placed.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = placed.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    both = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = both.select(F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "own", "node", "unit", "copies", "component")

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, own, node, copies, component = (table.column(i).to_numpy() for i in (0, 1, 2, 4, 5))
        unit = _matrix(table.column(3))
        cuts = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
        links = np.zeros(len(key), np.int64)
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            first = np.flatnonzero(own[x:y] == own[x]) + x
            second = np.flatnonzero(own[x:y] != own[x]) + x
            if len(second):
                hit = unit[first] @ unit[second].T >= linked
                links[first] = hit @ copies[second]
                links[second] = copies[first] @ hit
            else:
                hit = unit[first] @ unit[first].T >= linked
                np.fill_diagonal(hit, False)
                links[first] = hit @ copies[first]
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links)], names=["node", "links"])

    counted = rows.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: by_key(batches, work, 2 * BLOCK), "node long, links long")
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def near_vectors(vectors: DataFrame, linked: float = 0.9, neighbours: int = NEIGHBOURS, rounds: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for each row."""
    rows = staged(unit_vectors(vectors, id_col, vector_col), "units")
    classes = staged(rows.where("node is not null").groupBy("node").agg(F.first("unit").alias("unit"), F.count("*").alias("copies"), F.min("id").alias("least")), "classes")
    count = classes.count()
    head = classes.select("unit").first()
    floor = 2 * linked - 1 - 0.1 if linked > 0.6 else -1.0  # what is below is of no use as a way to a link
    if head:
        size = len(head.unit) // 8
        found = staged(_first_lists(classes, count, size, linked, floor, neighbours), "tables")
        links, lists = found, staged(_lists(found, neighbours), "lists")
        mark = None
        for _ in range(rounds):
            more = staged(_joined(lists, classes, linked, floor, neighbours), "neighbours")
            links = links.union(more)
            lists = staged(_lists(lists.union(more), neighbours), "lists")
            now = lists.agg(F.count("*"), F.sum("cosine")).first()
            if mark and now[0] == mark[0] and abs((now[1] or 0) - (mark[1] or 0)) < 1e-3 * max(1, now[0]):
                break
            mark = now
        settled = staged(_settled(links, classes, linked), "settled")
        more = _across(_coded(classes, count, size, linked, False), classes, components(settled), linked)
        member = components(settled.union(_settled(staged(more, "across"), classes, linked)))
    else:
        member = components(classes.select(F.col("node").alias("a"), F.col("node").alias("b")))
    placed = staged(classes.join(member, "node").select("component", "node", "unit", "copies", "least"), "placed")
    links = _enlarged(placed, linked)
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    linked_classes = placed.join(named, "component").join(links, "node").select("node", "component_id", "links")
    each = classes.join(linked_classes, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("named"))
    out = rows.select("id", "node").join(each, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("named"))
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.col(id_col).isNull() & F.col("component_id").isNull()))


def recall(vectors: DataFrame, result: DataFrame, linked: float = 0.9, step: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 5000) -> float:
    """Links found over links there are, of the vectors whose id `step` divides, by brute force; an audit of at most `most` of them."""
    rows = unit_vectors(vectors, id_col, vector_col).where("unit is not null")
    asked = rows.where((F.col("id") % step == 0)).orderBy(F.xxhash64("id")).limit(most).select("id", "unit").toArrow()
    if not asked.num_rows:
        return 1.0
    queries = _matrix(asked.column(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(queries), np.int64)
        for batch in batches:
            if batch.num_rows:
                total += (queries @ _matrix(batch.column(0)).T >= linked).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["q", "n"])

    truth = rows.select("unit").mapInArrow(run, "q long, n long").agg(F.sum("n")).first()[0] - len(queries)
    chosen = result.sparkSession.createDataFrame([(i,) for i in asked.column(0).to_pylist()], "id long")
    got = result.join(F.broadcast(chosen), result[id_col] == chosen.id).agg(F.sum("n_links")).first()[0] or 0
    return got / truth if truth else 1.0
