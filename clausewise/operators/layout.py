"""Lines of pages: reading order, rows joined, headers and footers removed, labels read. Built-ins only.

Lines have doc, page, width, height (of the page), x0, y0, x1, y1 and text. A page is the largest group that is held
together. Blank and null texts are no lines; a page without lines gives none; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW = 2.5
CENTRE = 5
MARGIN = 0.09
PLACE = ("doc", "page")


def ordered(lines: DataFrame) -> DataFrame:
    """lines with col (0 left, 1 right) and place, the sort key within a page.

    A line across the page's middle opens a band; in each band the left column is read before the right one.
    """
    mid = F.col("width") / 2
    out = lines.where(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")) != "").withColumn("col", F.when(F.col("x0") < mid, 0).otherwise(1))
    out = out.withColumn("across", (F.col("x0") < mid - CENTRE) & (F.col("x1") > mid + CENTRE))
    # the frame ends just above a row's tolerance: a line at the very tolerance opens no band below it
    before = F.expr(f"sum(cast(across as int)) over (partition by {', '.join(PLACE)} order by y0 range between unbounded preceding and {ROW + 1e-9}D preceding)")
    nth = F.rank().over(Window.partitionBy(*PLACE, "across").orderBy("y0"))
    band = F.when(F.col("across"), nth).otherwise(F.coalesce(before, F.lit(0)).cast("int"))
    row = F.bround(F.col("y0") / ROW).cast("long")
    beside = F.when(F.col("across"), 0).otherwise(1)
    column = F.when(F.col("across"), 0).otherwise(F.col("col"))
    return out.withColumn("place", F.struct(band.alias("band"), beside.alias("beside"), column.alias("column"), row.alias("row"), "x0", "x1", "text")).drop("across")


def merged(lines: DataFrame) -> DataFrame:
    """(doc, page, height, n, col, x0, y0, x1, y1, text): lines of ordered() with those of one row and column joined.

    Each line is held against the joined line before it, whose y0 stays that of its first part.
    """
    line = "struct<col:int,x0:double,y0:double,x1:double,y1:double,text:string>"
    parts = F.struct("place", F.col("col").cast("int").alias("col"), *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), "text")
    pages = lines.groupBy(*PLACE).agg(F.max("height").alias("height"), F.array_sort(F.collect_list(parts)).alias("lines"))

    def step(acc: Column, new: Column) -> Column:
        last = acc.getField("last")
        same = (last.col == new.col) & (F.abs(last.y0 - new.y0) <= ROW) & (new.x0 >= last.x1 - 1)
        own = F.struct(*(new.getField(c).alias(c) for c in ("col", "x0", "y0", "x1", "y1", "text")))
        text = F.concat(F.rtrim(last.text), F.lit(" "), F.ltrim(new.text))
        joined = F.struct(last.col.alias("col"), last.x0.alias("x0"), last.y0.alias("y0"), F.greatest(last.x1, new.x1).alias("x1"), F.greatest(last.y1, new.y1).alias("y1"), text.alias("text"))
        done = F.when(same | last.isNull(), acc.done).otherwise(F.concat(acc.done, F.array(last)))
        return F.struct(done.alias("done"), F.when(same, joined).otherwise(own).alias("last"))

    start = F.struct(F.array().cast(f"array<{line}>").alias("done"), F.lit(None).cast(line).alias("last"))
    rows = F.aggregate("lines", start, step, lambda acc: F.concat(acc.done, F.array(acc.getField("last"))))
    return pages.select(*PLACE, "height", F.posexplode(rows).alias("n", "line")).select(*PLACE, "height", "n", "line.*")


def without_margins(lines: DataFrame) -> DataFrame:
    """Lines of merged() without those in the top or bottom margin whose text, digits aside, is on many pages.

    Many: two pages of a document of at most three, else the greater of three and two fifths of its pages.
    """
    key = F.lower(F.trim(F.regexp_replace(F.regexp_replace("text", r"(?U)\s+", " "), r"(?U)\d+", "#")))
    keyed = lines.withColumn("key", key)
    pages = keyed.groupBy("doc").agg(F.countDistinct("page").alias("n_pages"))
    many = F.when(F.col("n_pages") <= 3, 2).otherwise(F.greatest(F.lit(3), F.floor(F.col("n_pages") * 0.4)))
    often = keyed.groupBy("doc", "key").agg(F.countDistinct("page").alias("on")).join(pages, "doc").where(F.col("on") >= many).select("doc", "key", F.lit(True).alias("often"))
    edge = (F.col("y0") < MARGIN * F.col("height")) | (F.col("y1") > (1 - MARGIN) * F.col("height"))
    return keyed.join(often, ["doc", "key"], "left").where(~(edge & F.coalesce("often", F.lit(False)))).drop("key", "often")


def column_bases(lines: DataFrame, label: Column) -> DataFrame:
    """(doc, col, base): the leftmost x0 of the lines that begin with a label."""
    return lines.where(label != "").groupBy("doc", "col").agg(F.min("x0").alias("base"))


def leading(lines: DataFrame) -> DataFrame:
    """(doc, page, col, leading, threshold): the upper median of the gaps between 4 and 40 that follow each other."""
    order = Window.partitionBy(*PLACE, "col").orderBy("n")
    gaps = lines.withColumn("gap", F.lead("y0").over(order) - F.col("y0"))
    kept = F.array_sort(F.collect_list(F.when((F.col("gap") > 4) & (F.col("gap") < 40), F.col("gap"))))
    found = gaps.groupBy(*PLACE, "col").agg(kept.alias("gaps"))
    middle = F.coalesce(F.get("gaps", F.floor(F.size("gaps") / 2).cast("int")), F.lit(12.0))
    return found.select(*PLACE, "col", middle.alias("leading"), F.greatest(F.lit(19.0), 1.45 * middle).alias("threshold"))
