"""Readers and writers of forms, accounts, extractions and indexes; each result is a DataFrame, each store is Parquet or JSON."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


LINES = "doc string, page int, width double, height double, x0 double, y0 double, x1 double, y1 double, text string"


def read_lines(spark: SparkSession, path: str, extract: Callable[[bytes], Iterable[tuple]]) -> DataFrame:
    """(LINES) of the files at a path; extract: a file's bytes to rows of LINES without doc. A file is named by its name without ending."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in LINES.split(", ")]
        for batch in batches:
            for file, content in zip(batch.path, batch.content, strict=True):
                doc = file.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                yield pd.DataFrame([(doc, *row) for row in extract(content)], columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, LINES)


def first_accounts(accounts: DataFrame, n: int | None, *others: DataFrame) -> tuple[DataFrame, ...]:
    """The first n accounts (all of them without n), and of other tables the rows of those; the limit is the feature."""
    chosen = accounts if n is None else accounts.orderBy("account").limit(n)
    return chosen, *(df.join(chosen.select("account"), "account", "left_semi") for df in others)


def write_resolved(resolved, path: str) -> None:
    """The changed clauses of every account in a folder of its own, held and unresolved operations beside them."""
    write_partitioned(resolved.changed, f"{path}/changed", "account")
    for name in ("held", "unresolved"):
        getattr(resolved, name).write.mode("overwrite").parquet(f"{path}/{name}")


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """JSON documents (or lines) with a stated schema, so that nothing is read twice to infer it."""
    return spark.read.schema(schema).json(path, multiLine=not lines)


def read_extractions(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Operations of one amendment (its partition only), or of all of them in order with the file that each came from."""
    rows = spark.read.parquet(path).withColumn("file", F.col("_metadata.file_name"))
    return rows.orderBy("amendment", "file") if key is None else rows.where(F.col("amendment") == key)


def write_partitioned(rows: DataFrame, path: str, by: str) -> None:
    """One folder for each value of a column; rows of a large value stay in as many tasks as AQE gives it."""
    rows.hint("rebalance", by).write.partitionBy(by).mode("overwrite").parquet(path)


def read_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """A stored table, built and stored first if it is not there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    build().write.parquet(path)
    return spark.read.parquet(path)


def catalogue_entry(catalogue: DataFrame, key: str) -> DataFrame:
    """The entry 'id@edition', or the only one of a bare id; KeyError if there is none or if a bare id has several."""
    form, _, edition = key.partition("@")
    found = catalogue.where(F.col("id") == form)
    found = found.where(F.col("edition") == edition) if edition else found
    if len(found.take(2)) != 1:
        raise KeyError(key)
    return found


def write_index(chunks: DataFrame, path: str, variant: str, embedder: str) -> None:
    """Chunks with their vectors, and beside them the version, the embedder and the number of rows."""
    chunks.write.mode("overwrite").parquet(f"{path}/{variant}/chunks")
    spark = chunks.sparkSession
    stored = spark.read.parquet(f"{path}/{variant}/chunks").agg(F.count("*").alias("n_rows"))
    stored.select(F.lit(VERSION).alias("version"), F.lit(embedder).alias("embedder"), "n_rows").write.mode("overwrite").parquet(f"{path}/{variant}/about")


def read_index(spark: SparkSession, path: str, variant: str, embedder: str) -> DataFrame | None:
    """The stored chunks; None if they are not there, or if version, embedder or number of rows differ."""
    try:
        about = spark.read.parquet(f"{path}/{variant}/about").take(1)
        chunks = spark.read.parquet(f"{path}/{variant}/chunks")
    except AnalysisException:
        return None
    if not about or (about[0].version, about[0].embedder) != (VERSION, embedder) or chunks.count() != about[0].n_rows:
        return None
    return chunks


def outline(clauses: DataFrame, most: int = 90) -> DataFrame:
    """(ordinal, line): indented by level; the heading, else the term, else the first characters of the text."""
    said = F.coalesce(F.nullif("heading", F.lit("")), F.nullif("term", F.lit("")), F.substring("text", 1, most))
    return clauses.select("ordinal", F.concat(F.repeat(F.lit("  "), F.col("level").cast("int")), "label", F.lit(" "), said).alias("line"))


def review_lines(ops: DataFrame) -> DataFrame:
    """(amendment, op_no, line): operations that await a reader, as list items."""
    waits = ops.where("status is distinct from 'resolved'")
    return waits.select("amendment", "op_no", F.concat_ws(" ", F.lit("-"), F.concat(F.lit("["), "status", F.lit("]")), "amendment", "kind", F.coalesce("path", F.lit("(no target)")), F.substring("text", 1, 200)).alias("line"))
