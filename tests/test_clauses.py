"""Clause trees from hand-made lines; expected results are worked out by hand."""

import pytest

from clausewise.operators import clauses


def lines(*rows, doc="d"):
    """(text, indent[, gap before[, page, col]]) as lines 12 points apart."""
    out, y, place = [], 100.0, (1, 0)
    for n, row in enumerate(rows):
        text, indent, gap, page, col = (*row, *(0, 12, 1, 0)[len(row) - 1 :]) if len(row) < 5 else row
        y = 100.0 if (page, col) != place else y + gap
        place = (page, col)
        x = 50.0 + 250 * col + indent
        out.append((doc, n, page, col, x, y, x + 200, y + 10, text))
    return out


def parsed(spark, rows, **how):
    got = clauses.parse(spark.createDataFrame(rows, clauses.LINES), **how)
    return got, {r.path: r for r in got.clauses.orderBy("ordinal").collect()}


FORM = lines(
    ("Contents .......... 3", 0),
    ("Read this form.", 0),
    ("I. AGREEMENT", 0, 30),
    ("A. We will pay for loss", 10),
    ("by water as follows:", 20),
    ("1. Buildings", 20),
    ("2. Goods in them, with a refer\u00ad ence to item", 20),
    ("9. which is no label here.", 30),
    ("Text that belongs to A again.", 15),
    ("B. Limits", 10),
    ("The most is said elsewhere.", 10),
    ("II. DEFINITIONS", 0, 30),
    ("1. Basement. Any area below ground.", 10),
    ("2. Flood", 10),
    ("a. rising water", 20),
    ("(1) of a river", 30),
    ("(i) in spring", 40),
    ("(ii) in autumn", 40),
)


def test_tree_texts_and_warnings(spark):
    got, rows = parsed(spark, FORM)
    assert list(rows) == ["I", "I.A", "I.A.1", "I.A.2", "I.B", "II", "II.1", "II.2", "II.2.a", "II.2.a.(1)", "II.2.a.(1).(i)", "II.2.a.(1).(ii)"]
    assert rows["I.A"].text == "We will pay for loss by water as follows: Text that belongs to A again."
    assert rows["I.A.2"].text == "Goods in them, with a reference to item 9. which is no label here."
    assert (rows["I.A.1"].heading, rows["I.B"].heading, rows["I.A"].heading) == ("Buildings", "Limits", None)
    # a line at a label's own indent belongs to the clause above
    assert (rows["I.B"].text, rows["I"].text) == ("Limits", "AGREEMENT The most is said elsewhere.")
    assert (rows["II"].heading, rows["II.1"].term, rows["II.2"].term, rows["II.2.a"].term) == ("DEFINITIONS", "Basement", "Flood", None)
    assert (rows["I.A.2"].parent_path, rows["I.A.2"].level, rows["II.2.a.(1).(i)"].level) == ("I.A", clauses.NUMBER, clauses.IN_ROMAN)
    assert [r.preamble for r in got.preambles.collect()] == ["Read this form."]
    warnings = got.warnings.collect()
    assert len(warnings) == 1 and warnings[0].warning.startswith("rejected 9 at num (expected 3): 9. which")


def test_ninth_letter_and_roman(spark):
    rows = lines(("A. x", 0), *((f"({c}) item", 10) for c in "abcdefghi"), ("B. y", 0), ("(a) z", 10), ("(i) roman", 20))
    _, got = parsed(spark, rows)
    assert "A.(i)" in got and got["A.(i)"].level == clauses.IN_LOWER
    assert got["B.(a).(i)"].level == clauses.IN_ROMAN


def test_word_headings_and_quoted_paragraphs(spark):
    rows = lines(("DEFINITIONS", 0), ("\u201cActual cash value\u201d means the cost", 0, 30), ("less wear", 0), ("and", 0), ("tear.", 0), ("\u201cFlood\u201d means water", 0, 30), ("that", 0), ("rises.", 0), ("COVERAGE A (Dwelling)", 0, 30), ("We cover it.", 0, 30))
    _, got = parsed(spark, rows)
    assert list(got) == ["DEFINITIONS", "DEFINITIONS.p1", "DEFINITIONS.p2", "COVERAGE-A-DWELLING", "COVERAGE-A-DWELLING.p1"]
    assert (got["DEFINITIONS.p1"].term, got["DEFINITIONS.p2"].term) == ("Actual cash value", "Flood")
    assert got["DEFINITIONS.p1"].text.endswith("the cost less wear and tear.")


def test_loose_reading_and_root_paragraphs(spark):
    rows = lines(("This changes the policy.", 0), ("Item is replaced:", 0, 30), ("5. Basement is new.", 18, 30), ("All other terms remain.", 0, 30))
    _, got = parsed(spark, rows, strict=False, root_paragraphs=True)
    assert [(p, r.text) for p, r in got.items()][:1] == [("p1", "This changes the policy. Item is replaced:")] or list(got)[0] == "p1"
    assert any(r.text.startswith("Basement is new.") for r in got.values())


def test_boxes_follow_columns(spark):
    rows = lines(("I. ONE", 0), ("A. text goes", 10), ("on here", 20), ("and in the next column", 20, 12, 1, 1))
    _, got = parsed(spark, rows)
    assert [(b.page, b.x0) for b in got["I.A"].boxes] == [(1, 60.0), (1, 320.0)]


def test_empty_null_and_repeated(spark):
    got, rows = parsed(spark, [("d", 0, 1, 0, 1.0, 1.0, 2.0, 2.0, None)])
    assert rows == {} and got.preambles.count() == 0
    got, rows = parsed(spark, [])
    assert rows == {} and got.warnings.count() == 0
    _, rows = parsed(spark, lines(("A. one", 0), ("A. two", 0)), strict=False)
    both = clauses.by_path(clauses.parse(spark.createDataFrame(lines(("A. one", 0), ("A. two", 0)), clauses.LINES), strict=False).clauses).collect()
    assert [(r.path, r.text) for r in both] == [("A", "two")]


@pytest.mark.parametrize(("level", "label", "after"), [(0, "IX", "X"), (0, "XV", None), (1, "Z", None), (2, "9", "10"), (6, "iv", "v"), (5, "a", "b")])
def test_following(level, label, after):
    assert clauses.following(level, label) == after
