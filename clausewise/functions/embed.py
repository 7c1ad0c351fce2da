"""The hash embedder: unigrams and adjacent bigrams hashed to signed buckets, scaled to unit length."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

DIM = 512
WORD = re.compile(r"[a-z0-9$]+(?:\.\d+)?")


def vectors(texts: list[str | None], dim: int = DIM) -> np.ndarray:
    """A row for each text: every distinct gram of the batch is hashed once, and all rows are added in one call.

    A text without words (or null) has the zero vector.
    """
    words = [WORD.findall(t.lower()) if t else [] for t in texts]
    grams = [w + [f"{a}_{b}" for a, b in zip(w, w[1:])] for w in words]
    known = {g: i for i, g in enumerate(dict.fromkeys(g for row in grams for g in row))}
    hashed = np.frombuffer(b"".join(hashlib.blake2b(g.encode(), digest_size=8).digest() for g in known), ">u8").astype(np.uint64)
    gram = np.array([known[g] for row in grams for g in row], np.int64)
    row = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
    sign = np.where(hashed >> np.uint64(63) == 1, 1.0, -1.0)
    place = row * dim + (hashed % np.uint64(dim)).astype(np.int64)[gram]
    out = np.bincount(place, sign[gram], minlength=len(texts) * dim).reshape(len(texts), dim)
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return (out / np.where(length == 0, 1, length)).astype(np.float32)


def vector(text: str | None, dim: int = DIM) -> np.ndarray:
    """One text's vector."""
    return vectors([text], dim)[0]


@F.pandas_udf(ArrayType(FloatType()))
def hashed(texts: pd.Series) -> pd.Series:
    return pd.Series(list(vectors(texts.tolist())))


def embedded(rows: DataFrame, text: str, cache: DataFrame | None = None, embed=hashed) -> DataFrame:
    """rows with `embedding`: each distinct text is embedded once, and not at all if the cache (digest, embedding) has it."""
    keyed = rows.withColumn("digest", F.sha1(F.coalesce(F.col(text), F.lit(""))))
    texts = keyed.groupBy("digest").agg(F.first(text).alias("_text"))
    if cache is not None:
        texts = texts.join(cache, "digest", "left_anti")
    made = texts.select("digest", embed(F.col("_text")).alias("embedding"))
    every = made if cache is None else made.unionByName(cache.select("digest", "embedding"))
    return keyed.join(every, "digest").drop("digest")
