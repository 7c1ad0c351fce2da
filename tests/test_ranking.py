"""Ranking steps on long and many rows: what is done once for a document or vector is not done for each of its rows."""

import re

import pytest
from pyspark.sql import functions as F

from clausewise.operators import ranking


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("a", 1, "flood zone flood"), ("a", 2, "zone wind"), ("a", 3, ""), ("a", 4, None), ("b", 5, "flood"), ("b", 6, " ".join(["wind", "hail"] * 20_000)), (None, 7, "flood")]
    return spark.createDataFrame(rows, "tenant string, key long, text string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "flood"), (1, "flood"), (1, "zone"), (2, "hail"), (2, "wind")], "query_id long, token string")


@pytest.mark.parametrize("rank", [ranking.bm25, ranking.overlap])
def test_tokens_of_a_document_are_found_once(docs, asked, rank):
    got = plan(rank(docs, asked, "tenant", "key", "text", 5))
    for row in got.splitlines():
        assert not re.search(r"Generate explode\S*\(regexp_extract_all", row) and "size(regexp_extract_all" not in row


@pytest.mark.parametrize("most", [ranking.FEW, 0])
def test_scores_with_few_and_with_many_questions(docs, asked, most, monkeypatch):
    monkeypatch.setattr(ranking, "FEW", most)
    got = {(r.query_id, r.tenant, r.key): (round(r.score, 4), r.rank) for r in ranking.bm25(docs, asked, "tenant", "key", "text", 5).collect()}
    few = {(r.query_id, r.tenant, r.key): (r.score, r.rank) for r in ranking.overlap(docs, asked, "tenant", "key", "text", 5).collect()}
    assert few == {(1, "a", 1): (2, 1), (1, "a", 2): (1, 2), (1, "b", 5): (1, 1), (2, "a", 2): (1, 1), (2, "b", 6): (2, 1)}
    assert set(got) == {(1, "a", 1), (1, "a", 2), (2, "a", 2)} and all(v[0] > 0 for v in got.values())
    one = ranking.bm25(docs, asked.select(F.lit("a").alias("tenant"), "query_id", "token"), "tenant", "key", "text", 5).collect()
    assert {(r.query_id, r.tenant, r.key): (round(r.score, 4), r.rank) for r in one} == got


def test_lengths_are_found_once_for_a_vector(spark):
    vectors = spark.createDataFrame([("a", 1, [3.0, 4.0]), ("a", 2, [4.0, 3.0]), ("b", 3, [1.0, 0.0])], "tenant string, key long, v array<double>")
    got = ranking.dense(vectors, vectors.select("tenant", F.col("key").alias("query_id"), F.col("v").alias("query")), "tenant", "key", "v", 2, ranking.cosine)
    assert max(row.count("zip_with(") for row in plan(got).splitlines()) == 1
    assert {(r.query_id, r.key, r.score, r["rank"]) for r in got.collect()} == {(1, 1, 1.0, 1), (1, 2, 0.96, 2), (2, 2, 1.0, 1), (2, 1, 0.96, 2), (3, 3, 1.0, 1)}
