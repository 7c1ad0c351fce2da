import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewise.functions import embed
from clausewise.sources import stores


def test_index_is_read_only_if_it_fits(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "deductible $500"), ("c2", None)], "chunk_id string, text string")
    rows = embed.embedded(chunks, "text")
    stores.write_index(rows, str(tmp_path), "clause", "hash-512")
    got = stores.read_index(spark, str(tmp_path), "clause", "hash-512")
    made = {r.chunk_id: np.array(r.embedding) for r in got.collect()}
    assert np.isclose(np.linalg.norm(made["c1"]), 1) and not made["c2"].any()
    assert stores.read_index(spark, str(tmp_path), "clause", "other") is None
    assert stores.read_index(spark, str(tmp_path), "fixed", "hash-512") is None
    rows.limit(1).write.mode("append").parquet(f"{tmp_path}/clause/chunks")
    assert stores.read_index(spark, str(tmp_path), "clause", "hash-512") is None


def test_cached_texts_are_not_embedded_again(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "id int, text string")
    cache = spark.createDataFrame([("x", [9.0])], "digest string, embedding array<float>").withColumn("digest", F.sha1(F.lit("c")))
    got = {r.id: list(r.embedding) for r in embed.embedded(rows, "text", cache).collect()}
    assert got[3] == [9.0] and got[1] == got[2] and len(got[1]) == 512


def test_catalogue_and_partitions(spark, tmp_path):
    entries = spark.createDataFrame([("a", "2020"), ("a", "2021"), ("b", "2020")], "id string, edition string")
    assert stores.catalogue_entry(entries, "a@2021").count() == 1 and stores.catalogue_entry(entries, "b").count() == 1
    for key in ("a", "c", "b@1999"):
        with pytest.raises(KeyError):
            stores.catalogue_entry(entries, key)
    ops = spark.createDataFrame([("x", 1, "resolved"), ("y", 2, "held")], "amendment string, op_no int, status string")
    stores.write_partitioned(ops, f"{tmp_path}/ops", "amendment")
    assert stores.read_extractions(spark, f"{tmp_path}/ops", "y").select("op_no").collect()[0][0] == 2
    assert stores.read_or_build(spark, f"{tmp_path}/n", lambda: spark.range(3)).count() == 3
    assert stores.read_or_build(spark, f"{tmp_path}/n", lambda: spark.range(9)).count() == 3


def test_files_are_read_laid_out_and_parsed(spark, tmp_path):
    """Two files of a made format (a line each: x, y, text) become clause trees."""
    from clausewise.operators import clauses, layout

    (tmp_path / "one.txt").write_text("50|100|I. FIRST\n60|130|A. said here\n80|142|and here\n")
    (tmp_path / "two.txt").write_text("")

    def extract(content):
        for line in content.decode().splitlines():
            x, y, text = line.split("|")
            yield 1, 600.0, 800.0, float(x), float(y), float(x) + 100, float(y) + 10, text

    lines = stores.read_lines(spark, str(tmp_path), extract)
    parsed = clauses.parse(clauses.from_layout(layout.merged(layout.ordered(lines)))).clauses.orderBy("ordinal").collect()
    assert [(r.doc, r.path, r.text) for r in parsed] == [("one", "I", "FIRST"), ("one", "I.A", "said here and here")]


def test_first_accounts_bring_their_rows(spark):
    accounts = spark.createDataFrame([("b",), ("a",), ("c",)], "account string")
    rows = spark.createDataFrame([("a", 1), ("c", 2), ("b", 3)], "account string, q int")
    chosen, kept = stores.first_accounts(accounts, 2, rows)
    assert sorted(r.account for r in chosen.collect()) == ["a", "b"] and sorted(r.q for r in kept.collect()) == [1, 3]
    assert stores.first_accounts(accounts, None, rows)[1].count() == 3
