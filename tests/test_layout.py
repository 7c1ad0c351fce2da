from pyspark.sql import functions as F

from clausewise.operators import layout

SCHEMA = "doc string, page int, width double, height double, x0 double, y0 double, x1 double, y1 double, text string"


def lines(spark, *rows):
    return spark.createDataFrame([("d", page, 600.0, 800.0, float(x0), float(y0), float(x1), float(y0) + 10, text) for page, x0, y0, x1, text in rows], SCHEMA)


def test_bands_columns_and_rows(spark):
    given = lines(
        spark,
        (1, 320, 100, 500, "right above"), (1, 50, 110, 250, "left above"), (1, 200, 150, 400, "HEADING"), (1, 320, 170, 500, "right below"),
        (1, 100, 170.5, 250, "text "), (1, 50, 170, 95, "A. "), (1, 50, 190, 250, "next"), (1, 60, 200, 90, "  "), (1, 60, 210, 90, None),
    )
    got = layout.merged(layout.ordered(given)).orderBy("n").collect()
    assert [r.text for r in got] == ["left above", "right above", "HEADING", "A. text ", "next", "right below"]
    assert (got[3].x0, got[3].x1, got[3].y0, got[3].y1) == (50, 250, 170, 180.5)


def test_margins(spark):
    rows = [(p, 50, 10, 200, f"Form  {p} of 4") for p in range(1, 5)] + [(p, 50, 400, 200, "Same body 1") for p in range(1, 5)]
    rows += [(p, 50, 780, 200, "Twice only") for p in (1, 2)]
    kept = layout.without_margins(layout.merged(layout.ordered(lines(spark, *rows))))
    assert sorted(r.text for r in kept.collect()) == ["Same body 1"] * 4 + ["Twice only"] * 2


def test_leading_and_bases(spark):
    rows = layout.merged(layout.ordered(lines(spark, *((1, 50, y, 200, t) for y, t in ((100, "A. x"), (112, "y"), (126, "z"), (200, "w"))), (1, 350, 100, 500, "1. q"))))
    got = {r.col: (r.leading, r.threshold) for r in layout.leading(rows).collect()}
    assert got == {0: (14.0, 1.45 * 14), 1: (12.0, 19.0)}
    bases = layout.column_bases(rows, F.regexp_extract("text", r"^([A-Z]|[0-9]+)\.", 0)).collect()
    assert {(r.col, r.base) for r in bases} == {(0, 50.0), (1, 350.0)}


def test_no_lines(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert layout.without_margins(layout.merged(layout.ordered(empty))).count() == 0
