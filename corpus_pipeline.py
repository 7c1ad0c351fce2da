"""A corpus pipeline: toxicity, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs has the columns of documents, and all stages but
the last return them. Nulls: a null text is empty to every stage and kept null until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.llm import minhash, packing, pii, suffix_dedup, toxicity
from clausewise.llm.common import marked, read, release, staged
from clausewise.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a machine fitted on the labelled documents scores below 0.5."""
    machine = toxicity.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, machine)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least id (nulls last); rows that link with nothing stay.

    It decides by row: of rows that are equal in all columns one stays, a null id wins only where its group has no other,
    and rows without words (null and empty texts too) all stay.
    """
    return minhash.one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the characters that lie in repeated 200-byte strings; n_chars follows the text."""
    return suffix_dedup.without_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, disguised forms included, replaced by its kind in brackets; n_chars follows the text."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequences and offsets."""
    return packing.best_fit(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", drop_repeats),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

#: No stage can be written in SQL: learned weights, byte offsets and a tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder before the next reads it.

    What a stage has staged for itself is deleted once its result is written.
    """
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        begin = marked()
        made = stage(spark, docs, sf_dir)
        end = marked()
        docs = staged(made, name)
        release(begin, end)
    return STAGES[-1][1](spark, docs, sf_dir)
