"""Bounded samples of labelled documents, and scoring with a fitted model."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import slices, trim

#: Labelled rows that a classifier is fitted on, at most.
SAMPLE_ROWS = 12_000


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled documents that are not held out, by the least hash of the id.

    The sampled labels, bounded by `rows`, are broadcast. Of several labels of one id the greatest counts, of several
    texts of one id the least (nulls count as empty); rows without id or label are left out.
    """
    chosen = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return met.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("label").alias("label"))


def fitted(sampled: DataFrame, features: Callable[[pa.StringArray], list[bytes]], fit: Callable[[list[bytes], np.ndarray], object]) -> object:
    """The model that `fit` makes of the sample's features and labels, ordered by id.

    It is fitted in one task, which holds the bounded sample; only the model comes to the driver.
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, text in slices(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(features(text), pa.binary()), rows.column(2)], names=["doc_id", "x", "label"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, labels = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            rows += batch.column(1).to_pylist()
            labels += batch.column(2).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], rows[i]))
        model = fit([rows[i] for i in order], np.array([labels[i] for i in order], np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])
        del rows, model
        trim()

    described = sampled.select(F.col("doc_id").cast("long"), "text", "label").mapInArrow(describe, "doc_id long, x binary, label int")
    made = described.repartition(1).mapInArrow(learn, "model binary").first()  # none where the plan is known to be empty
    return pickle.loads(made.model) if made else fit([], np.zeros(0))


def scored(docs: DataFrame, score: Callable[[pa.StringArray], np.ndarray], threshold: float, id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, score, predicted) for each row. One scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, text in slices(batches):
            value = score(text)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(value), pa.array((value >= threshold).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    return docs.select(F.col(id_col), held_out(id_col).alias("held_out"), "text").mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, held_out boolean, score double, predicted int")
