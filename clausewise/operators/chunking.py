"""Cutting texts into chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausewise.functions.text import chunk_id

SIZE, OVERLAP = 2048, 256
SEPARATORS = ("\n\n", "\n", ". ", " ")


def fixed_windows(docs: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_id, start, end, chunk): windows of `size` characters that overlap; empty texts give none.

    A text is first cut into pieces of `size - overlap` characters by one pattern, in time that follows its length; a
    window is a piece with the begin of the next ones.
    """
    step = size - overlap
    if overlap >= size or step < 1:
        raise ValueError("windows must be longer than their overlap")
    more = -(-overlap // step)
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    n = F.length(text)
    cut = docs.where(n > 0).select(key, n.alias("_n"), pieces.alias("_p"))
    count = F.greatest(F.lit(0), F.ceil((F.col("_n") - size) / step)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), count), lambda i: F.substring(F.array_join(F.slice("_p", i + 1, F.lit(more + 1)), ""), 1, size))
    at = cut.select(key, "_n", F.posexplode(windows).alias("_i", "chunk"))
    start = F.col("_i").cast("long") * step
    out = at.select(key, start.alias("start"), F.least(start + size, F.col("_n")).cast("long").alias("end"), "chunk")
    return out.select(key, chunk_id(F.col(key), F.col("start")).alias("chunk_id"), "start", "end", "chunk")


def paragraphs(docs: DataFrame, key: str, text: str, separator: str = "\n") -> DataFrame:
    """(key, n, paragraph): the non-blank parts of a text between separators, numbered from 0 as they stand."""
    parts = docs.select(key, F.posexplode(F.split(F.col(text), separator)).alias("n", "paragraph"))
    return parts.where(F.trim("paragraph") != "").withColumn("n", F.col("n").cast("long"))


def flat_offsets(rows: DataFrame, key: str, order: str, text: str, gap: int = 2) -> DataFrame:
    """Where each row's text begins and ends in the texts of its key joined in order by `gap` characters."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + gap).over(before), F.lit(0)).cast("long")
    return rows.withColumn("start", start).withColumn("end", (F.col("start") + F.length(text)).cast("long"))


def split_recursively(text: str, size: int = SIZE, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """Ranges of at most `size` characters that cover a text but for blank parts.

    A range that is too long is cut behind each place of the coarsest separator not tried yet; the parts are joined again
    as long as they fit, and parts that are still too long are cut by the next separator, at last by length.
    """
    done: list[tuple[int, int]] = []
    todo = [(0, len(text), 0)]  # a stack: the next range on top
    while todo:
        begin, end, level = todo.pop()
        if end - begin <= size:
            done.append((begin, end))
            continue
        if level == len(separators):
            done += [(a, min(end, a + size)) for a in range(begin, end, size)]
            continue
        cuts, at = [begin], text.find(separators[level], begin, end)
        while at >= 0:
            cuts.append(at + len(separators[level]))
            at = text.find(separators[level], cuts[-1], end)
        if cuts[-1] < end:
            cuts.append(end)
        joined: list[tuple[int, int, int]] = []
        for a, b in zip(cuts, cuts[1:]):
            if joined and b - joined[-1][0] <= size:
                joined[-1] = (joined[-1][0], b, level + 1)
            else:
                joined.append((a, b, level + 1))
        todo += reversed(joined)
    return [(a, b) for a, b in done if text[a:b].strip()]


def recursive_windows(docs: DataFrame, key: str, text: str, size: int = SIZE) -> DataFrame:
    """(key, n, start, end, chunk) of split_recursively; recursion is beyond built-in functions, so batches go through Arrow."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, n, a, b, t[a:b]) for k, t in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True) if t for n, (a, b) in enumerate(split_recursively(t, size))]
            yield pd.DataFrame(rows, columns=["key", "n", "start", "end", "chunk"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInPandas(run, f"key {kind}, n long, start long, end long, chunk string").withColumnRenamed("key", key)
