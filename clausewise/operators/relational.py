"""Relational helpers: as-of values, ordered folds, overlap and prefix joins, top-k, fusion, upserts. Built-ins only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(changes: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], when: Column | None = None) -> DataFrame:
    """The latest value of each key, by the order columns, among the rows that hold `when`; partial aggregation first."""
    rows = changes.where(when) if when is not None else changes
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def as_of_dates(changes: DataFrame, dates: Sequence[str], keys: Sequence[str], value: str, order: Sequence[str], at: str, most: int = 10_000) -> DataFrame:
    """The value in force at each of a few dates (as_of), given as strings in the type of `at`; at most `most` of them.

    Each change falls between two dates; the last of each key between two dates is kept (with partial aggregation), and
    holds for the dates up to the key's next one. Nothing is joined.
    """
    dates = sorted(set(dates))
    if len(dates) > most:
        raise ValueError(f"more than {most} dates")
    every = F.array(*(F.lit(d).cast(changes.schema[at].dataType) for d in dates))
    gap = F.size(F.filter(every, lambda d: d < F.col(at)))  # how many dates are before the change
    last = changes.withColumn("_gap", gap).where(F.col("_gap") < len(dates)).groupBy(*keys, "_gap").agg(F.max_by(value, F.struct(*order)).alias(value))
    then = F.coalesce(F.lead("_gap").over(Window.partitionBy(*keys).orderBy("_gap")), F.lit(len(dates))) - 1
    held = last.withColumn("_then", then).select(*keys, value, F.explode(F.sequence("_gap", "_then")).alias("_i"))
    return held.select(*keys, F.get(every, F.col("_i")).alias("as_of"), value)


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Pairs of half-open intervals (start_l, end_l) and (start_r, end_r) that overlap, as an equi-join on buckets of `width`.

    A pair that shares several buckets is kept in the bucket where the later of the two begins.
    """
    bucket = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    a = left.where("end_l > start_l").withColumn("bucket", bucket("start_l", "end_l"))
    b = right.where("end_r > start_r").withColumn("bucket", bucket("start_r", "end_r"))
    met = a.join(b, [*keys, "bucket"]).where("start_l < end_r and end_l > start_r")
    return met.where(F.col("bucket") == F.floor(F.greatest("start_l", "start_r") / width)).drop("bucket")


def ancestors(path: Column, separator: str) -> Column:
    """The path and all paths above it."""
    parts = F.split(path, f"[{separator}]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator))


def subtree_join(parents: DataFrame, rows: DataFrame, keys: Sequence[str], separator: str = ".") -> DataFrame:
    """Rows under each parent (its path or below): an equi-join on exploded ancestors instead of a prefix comparison."""
    return rows.withColumn("parent", F.explode(ancestors(F.col("path"), separator))).join(parents, [*keys, "parent"])


def top_k(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k of each group; Spark cuts each partition's groups to k before the exchange."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def fuse(rankings: Sequence[DataFrame], keys: Sequence[str], item: str, constant: int = 60, names: Sequence[str] = ()) -> DataFrame:
    """Reciprocal-rank fusion: sum of 1 / (constant + rank); ties go to the earlier list, then the better rank, then the item."""
    every = None
    for i, ranking in enumerate(rankings):
        one = ranking.select(*keys, item, "rank", F.lit(i).alias("list"))
        every = one if every is None else every.unionByName(one)
    fused = every.groupBy(*keys, item).agg(
        F.round(F.sum(1 / (F.lit(constant) + F.col("rank"))), 9).alias("score"), F.min(F.struct("list", "rank")).alias("first"), F.array_sort(F.collect_set("list")).alias("lists")
    )
    if names:  # which rankings an item is in, joined by '+'
        fused = fused.withColumn("via", F.array_join(F.transform("lists", lambda i: F.get(F.array(*map(F.lit, names)), i)), "+"))
    fused = fused.drop("lists")
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "first", item))).drop("first")


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], updated: Sequence[str], order: str) -> DataFrame:
    """current with the latest change of each key merged in: only `updated` columns change in rows that exist."""
    last = top_k(changes, keys, [F.desc(order)], 1, "nth").drop("nth")
    joined = current.alias("c").join(last.alias("n"), list(keys), "full")
    value = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"c.{c}")) if c in updated else F.coalesce(F.col(f"c.{c}"), F.col(f"n.{c}"))
    return joined.select(*keys, *(value(c).alias(c) for c in current.columns if c not in keys))


def fold(rows: DataFrame, keys: Sequence[str], order: Sequence[str], kind: str, text: str) -> DataFrame:
    """Operations in order on each key: REPLACE sets the text and revives, DELETE withdraws, AMEND appends.

    Result: text, active, and the number of operations applied. Operations of one key are folded in the JVM.
    """
    step = lambda acc, op: F.struct(
        F.when(op.kind == "REPLACE", op.text).when(op.kind == "AMEND", F.concat_ws(" ", acc.text, op.text)).otherwise(acc.text).alias("text"),
        F.when(op.kind == "REPLACE", F.lit(True)).when(op.kind == "DELETE", F.lit(False)).otherwise(acc.active).alias("active"),
        (acc.n + 1).alias("n"),
    )
    start = F.struct(F.lit(None).cast("string").alias("text"), F.lit(True).alias("active"), F.lit(0).cast("long").alias("n"))
    ops = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(kind).alias("kind"), F.col(text).cast("string").alias("text")))).alias("ops"))
    return ops.withColumn("state", F.aggregate("ops", start, step)).select(*keys, "state.*")
