from pyspark.sql import functions as F

from clausewise.operators import references


def test_terms(spark):
    clauses = spark.createDataFrame([("D.1", "Basement"), ("D.2", "Flood (surface)"), ("D.3", "Elevated Building"), ("D.4", "Building"), ("D.5", "basement"), ("D.6", None)], "path string, term string")
    asked = spark.createDataFrame([("BASEMENT.",), ("flood surface",), ("elev",), ("buildi",), ("building",), ("roof",), ("--",), (None,), ("roof",)], "term string")
    got = {r.term: (r.path, r.confidence, r.alternates) for r in references.resolve_terms(asked, clauses).collect()}
    assert got == {
        "BASEMENT.": (None, 0.3, ["D.1", "D.5"]), "flood surface": ("D.2", 0.95, []), "elev": ("D.3", 0.7, []), "buildi": (None, 0.0, []),
        "building": ("D.4", 0.95, []), "roof": (None, 0.0, []), "--": (None, 0.0, []), None: (None, 0.0, []),
    }


def test_words(spark):
    row = spark.range(1).select(references.reference_words(F.lit("Under the Exclusions of Section V.D")).alias("w"), references.singular(F.lit("limits")).alias("a"), references.singular(F.lit("gas")).alias("b")).first()
    assert (row.w, row.a, row.b) == (["exclusions", "v", "d"], "limit", "gas")
