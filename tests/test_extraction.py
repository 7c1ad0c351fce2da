"""Amendments read into operations; results are worked out by hand."""

import pytest
from pyspark.sql import functions as F

from clausewise.operators import extraction, references

BASE = [
    ("I", 0, "I", "AGREEMENT", None), ("II", 0, "II", "DEFINITIONS", None), ("II.C", 1, "C", None, None), ("II.C.5", 2, "5", "Basement", "Basement"), ("II.C.16", 2, "16", "Elevated Building", "Elevated Building"),
    ("IV", 0, "IV", "PROPERTY NOT INSURED", None), ("IV.14", 2, "14", None, None), ("CONDITIONS", 0, "CONDITIONS", "CONDITIONS", None), ("CONDITIONS.4", 2, "4", "Your Duties After Loss", None),
    ("CONDITIONS.4.a", 3, "a", None, None), ("CONDITIONS.6", 2, "6", "Loss Settlement", None), ("EXCLUSIONS", 0, "EXCLUSIONS", "EXCLUSIONS", None), ("EXCLUSIONS.6", 2, "6", "Loss to Boats", None),
]


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """Plans of many small joins: one partition each."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([("b", i, *r) for i, r in enumerate(BASE)], "form string, ordinal long, path string, level int, label string, heading string, term string").coalesce(1).cache()


def test_sentences(spark):
    text = "Section IV. PROPERTY NOT INSURED is meant. Condition 4.b.(2). is not. See No. 5 Main St. Always; Then \u201cquoted\u201d: (a) here"
    got = spark.createDataFrame([(text,)], "t string").select(extraction.sentences(F.col("t"))).first()[0]
    assert got == ["Section IV. PROPERTY NOT INSURED is meant.", "Condition 4.b.(2). is not.", "See No. 5 Main St. Always;", "Then \u201cquoted\u201d:", "(a) here"]


def test_references(spark, base):
    expected = {
        "Paragraph II.C.5 (Basement) of Section II. DEFINITIONS": ("II.C.5", 0.95), "Section IV. PROPERTY NOT INSURED": ("IV", 0.95), "Your Duties After Loss Condition 4.a": ("CONDITIONS.4.a", 0.9),
        "item 14": ("IV.14", 0.7), "item 6": (None, 0.3), "Loss Settlement": ("CONDITIONS.6", 0.85), "the EXCLUSIONS clause": ("EXCLUSIONS", 0.8), "the Loss provision": ("CONDITIONS.6", 0.85), "nothing known": (None, 0.0), "": (None, 0.0),
    }
    asked = spark.createDataFrame([("b", r) for r in expected] + [("other", "item 14")], "form string, ref string")
    got = {(r.form, r.ref): r for r in references.resolve_refs(asked, base).collect()}
    assert {ref: (got["b", ref].path, got["b", ref].confidence) for ref in expected} == expected
    assert got["b", "item 6"].alternates == ["CONDITIONS.6", "EXCLUSIONS.6"] and got["other", "item 14"].path is None
    assert got["b", "the Loss provision"].alternates == ["EXCLUSIONS.6", "CONDITIONS.4"]


AMENDMENTS = {
    "r": [("p0", "Endorsement No. 7"), ("p1", "Paragraph II.C.5 (Basement) of Section II. DEFINITIONS is deleted and replaced by the following:"), ("p1.5", "Basement. Any area below grade."), ("p2", "All other terms of this policy remain.")],
    "d": [("p1", "In consideration of a premium, Paragraph IV.14 of Section IV. PROPERTY NOT INSURED is deleted."), ("p2", "Signed by us. Not read.")],
    "a": [("p1", "The following is added to Section IV. PROPERTY NOT INSURED:"), ("p1.17", "Solar panels."), ("p1.17.(a)", "Their mounts.")],
    "t": [("p1", "The definition of \u201cElevated Building\u201d in Paragraph II.C.16 is amended to include the following:"), ("p2", "A house on piers.")],
    "s": [("p1", "The following is added to Section IV. PROPERTY NOT INSURED: Sheds: ________ and no others.")],
    "l": [("p1", "This policy is amended as follows: We pay at most $5,000.")],
    "h": [("p1", "It is agreed that pets are family.")],
    "n": [("p1", "Nothing is directed here.")],
    "m": [("p1", "Condition 6 does not apply. The following condition 9 is added to the CONDITIONS: Be kind. Exclusion 6 is deleted in its entirety.")],
    "e": [],
}


def test_operations(spark, base):
    clauses = spark.createDataFrame([(f, i, p, t, 1) for f, rows in AMENDMENTS.items() for i, (p, t) in enumerate(rows)], "form string, ordinal long, path string, text string, page_start int")
    forms = spark.createDataFrame([(f, f"F-{f}", "b", "") for f in AMENDMENTS], "form string, form_id string, base string, preamble string")
    ops = extraction.extract(clauses, forms, base).cache()
    got = {(r.form, r.op_no): r for r in ops.collect()}
    brief = {k: (r.kind, r.path, r.label, r.status, r.confidence) for k, r in got.items()}
    assert brief == {
        ("r", 1): ("REPLACE", "II.C.5", None, "resolved", 0.95), ("d", 1): ("DELETE", "IV.14", None, "resolved", 0.95), ("a", 1): ("ADD", "IV", "17", "resolved", 0.95), ("t", 1): ("AMEND_DEF", "II.C.16", None, "resolved", 0.95),
        ("s", 1): ("ADD", "IV", None, "held", 0.95), ("l", 1): ("ADD", None, None, "unresolved", 0.0), ("h", 1): ("ADD", None, None, "held", 0.4), ("n", 1): ("ADD", None, None, "held", 0.0), ("e", 1): ("ADD", None, None, "held", 0.0),
        ("m", 1): ("DELETE", "CONDITIONS.6", None, "resolved", 0.9), ("m", 2): ("ADD", "CONDITIONS", "9", "resolved", 0.8), ("m", 3): ("DELETE", "EXCLUSIONS.6", None, "resolved", 0.9),
    }
    assert got["r", 1].text == "5. Basement. Any area below grade." and [tuple(f) for f in got["a", 1].fragments] == [(["17"], "Solar panels."), (["17", "(a)"], "Their mounts.")]
    assert got["a", 1].text == "17. Solar panels. (a) Their mounts." and got["s", 1].schedule_key == "F-s" and got["m", 2].text == "Be kind."
    assert got["n", 1].text == "Nothing is directed here." and got["e", 1].text is None and got["l", 1].text == "We pay at most $5,000."
    expected = spark.createDataFrame([("a", 1, "ADD", "IV", "17", "Solar", False), ("s", 1, "ADD", "IV", None, None, True), ("d", 1, "DELETE", "IV.15", None, None, False), ("l", 1, "ADD", None, None, "$5,000", False)], "form string, nth int, kind string, path string, label string, contains string, schedule boolean")
    assert {(r.form, r.matched, r.status, r.n_ops) for r in extraction.compared(expected, ops).collect()} == {("a", True, "resolved", 1), ("s", True, "held", 1), ("d", False, None, 1), ("l", True, "unresolved", 1)}

    def ask(frames):
        for f in frames:
            yield f.assign(op_no=1, kind="ADD", ref=None, term=None, path="IV", label=None, text="x", fragments=[[] for _ in f.form], schedule_key=None, method="", confidence=2.0, status="", notes=[[] for _ in f.form], page=1, directive="")[[c.split(" ")[0] for c in extraction.OPS.split(", ")]]

    made = {r.form: r for r in extraction.with_model(ops, forms, ask).collect() if r.method == "model"}
    assert set(made) == {"s", "l", "h", "n"} and {(r.confidence, r.status) for r in made.values()} == {(0.85, "resolved")}
