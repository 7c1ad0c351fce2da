"""Plans and results of steps that must not do work again for each row of a group."""

from pyspark.sql import functions as F

from clausewise.operators import clauses, generators


def test_changes_are_made_once_to_be_exploded(spark):
    asked = generators.declaration_questions(generators.accounts(spark, 20, 7))
    assert "Filter (size(" not in asked._jdf.queryExecution().executedPlan().toString()
    assert asked.where("difficulty = 'as-of'").count() > 0


def test_no_line_holds_the_gaps_of_its_page(spark):
    lines = spark.range(3).select(F.lit("a").alias("doc"), F.col("id").alias("n"), F.lit(1).alias("page"), F.lit(0).alias("col"), F.lit(50.0).alias("x0"), (12.0 * F.col("id") * F.col("id")).alias("y0"), F.lit(500.0).alias("x1"), (12.0 * F.col("id") * F.col("id") + 10).alias("y1"), F.lit("so it is.").alias("text"))
    told = clauses.described(lines)
    assert "collect_list" not in told._jdf.queryExecution().executedPlan().toString()
    assert [r.breaks for r in told.orderBy("n").collect()] == [False, False, False]  # gaps of 12 and 36: the upper median is 36
    far = clauses.parse(lines.unionByName(lines.withColumn("doc", F.lit("b"))), strict=False, root_paragraphs=True).clauses
    assert sorted((r.doc, r.path, r.text) for r in far.collect()) == [(d, "p1", "so it is. so it is. so it is.") for d in "ab"]
