"""Lines of numbered forms read into clause trees.

What a single line says (its label, whether it is a heading, whether a paragraph breaks before it) is found by windows
and patterns for all documents at once. Only the automaton that opens and closes clauses runs in Python, over the lines of
one document: for each line it names the clause that the line belongs to. Texts, headings, defined terms and boxes are
then aggregated from the lines of each clause.

Lines have doc, n (their order in the document), page, col, x0, y0, x1, y1 and text. A document is the largest group that
is held together. Defined results: null texts are empty; a document without lines gives no clause; of clauses with one path
the last counts in by_path(); other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECTION, UPPER, NUMBER, LOWER, IN_NUMBER, IN_LOWER, IN_ROMAN = range(7)
LEVELS = ("section", "upper", "num", "lower", "paren-num", "paren-lower", "paren-roman")
PARAGRAPH = 1
SLACK = 3.0
GAP, GAP_FACTOR, LEADING = 19.0, 1.45, 12.0
#: The shapes of labels, headings and lines of a table of contents.
LABEL = r"^\s*(\((?:\d{1,2}|[a-z]|[ivx]{1,4})\)|[IVX]{1,5}\.|[A-Z]\.|\d{1,2}\.|[a-z]\.)(?=\s|$)\s*(.*)$"
HEADING = r"^[A-Z][A-Z ,&'()\-/]{2,44}$"
LEADING_CAPITALS = r"^[A-Z]{3,}\b[^.;:]{0,40}$"
CONTENTS = r"(\.\s?){4,}\s*\d+\s*$|\u2026{2,}"
ROMANS = "I II III IV V VI VII VIII IX X XI XII XIII XIV XV".split()
#: A defined term at the head of a numbered definition, or of a quoted one.
NUMBERED_TERM = r"^([A-Z][A-Za-z0-9'() \-/]{1,50}?)(?:\.\s|$)"
QUOTED_TERM = "^[\u201c\"]([^\u201d\"]{2,60})[\u201d\"]"

LINES = "doc string, n long, page int, col int, x0 double, y0 double, x1 double, y1 double, text string"
_PLACED = "node int, opens boolean, level int, label string, path string, parent_path string, kind string, label_x double, warning string"


def from_layout(lines: DataFrame) -> DataFrame:
    """(LINES) of layout.merged() or layout.without_margins(): numbered through each document."""
    order = Window.partitionBy("doc").orderBy("page", "n")
    return lines.withColumn("n", F.row_number().over(order).cast("long")).select("doc", "n", "page", "col", "x0", "y0", "x1", "y1", "text")


def cleaned(text: Column) -> Column:
    """Soft hyphens healed, white space collapsed."""
    out = F.regexp_replace(F.regexp_replace(text, "\u00ad ", ""), "\u00ad", "")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def slug(heading: Column) -> Column:
    """The label of a word heading: 'COVERAGE A (Dwelling)' gives COVERAGE-A-DWELLING."""
    return F.regexp_replace(F.regexp_replace(F.upper(heading), "[^A-Z0-9]+", "-"), "^-+|-+$", "")


def described(lines: DataFrame) -> DataFrame:
    """Lines without those of contents, with label, rest, rel_x, heading, breaks (a paragraph begins) and the cleaned text."""
    lines = lines.select("doc", "n", "page", "col", "x0", "y0", "x1", "y1", F.coalesce("text", F.lit("")).alias("text")).where(~F.col("text").rlike(CONTENTS))
    labelled = lines.withColumn("label", F.regexp_extract("text", LABEL, 1)).withColumn("rest", F.regexp_extract("text", LABEL, 2)).withColumn("clean", cleaned(F.col("text")))
    order = Window.partitionBy("doc").orderBy("n")
    before, after = (lambda c: F.lag(c).over(order)), (lambda c: F.lead(c).over(order))
    seen = labelled.withColumns(
        {
            "stays": (before("page") == F.col("page")) & (before("col") == F.col("col")),
            "goes_on": (after("page") == F.col("page")) & (after("col") == F.col("col")),
            "gap": F.col("y0") - before("y0"),
            "next_gap": after("y0") - F.col("y0"),
            "ended": before("clean").rlike("[.:;]$"),
            "first": before("n").isNull(),
        }
    )
    per_column = Window.partitionBy("doc", "page", "col")
    # the upper median of a column's gaps, by their places: no row holds the gaps of all
    gap = F.when(F.col("goes_on") & (F.col("next_gap") > 4) & (F.col("next_gap") < 40), F.col("next_gap"))
    seen = seen.withColumn("leading", gap).withColumn("place", F.row_number().over(per_column.orderBy(F.asc_nulls_last("leading"))) - 1).withColumn("middle", F.floor(F.count("leading").over(per_column) / 2))
    median = F.max(F.when(F.col("place") == F.col("middle"), F.col("leading"))).over(per_column)
    seen = seen.withColumn("least", F.greatest(F.lit(GAP), GAP_FACTOR * F.coalesce(median, F.lit(LEADING))))
    base = F.min(F.when(F.col("label") != "", F.col("x0"))).over(Window.partitionBy("doc", "col"))
    shape = F.col("clean").rlike(HEADING) | F.col("clean").rlike(LEADING_CAPITALS)
    letters = F.length(F.regexp_replace("clean", r"[^\p{L}]", "")) >= 3
    whole = ~F.col("clean").rlike(r"[,/\-;:.]$") & ~F.contains("clean", F.lit(". ")) & (F.size(F.split("clean", " ")) <= 7)
    alone = (~F.coalesce("stays", F.lit(False)) | (F.col("gap") >= F.col("least"))) & (~F.coalesce("goes_on", F.lit(False)) | (F.col("next_gap") >= F.col("least")))
    starts = F.col("text").rlike("^(?U)\\s*[\\p{Lu}\u201c\"]")
    wide = F.coalesce(F.col("stays") & (F.col("gap") >= F.col("least")), F.lit(False))
    turned = ~F.col("first") & ~F.coalesce("stays", F.lit(False)) & F.coalesce("ended", F.lit(False)) & starts
    return seen.select(
        *lines.columns, "label", "rest", "clean", (F.col("x0") - F.coalesce(base, "x0")).alias("rel_x"), ((F.col("label") == "") & shape & letters & whole & alone).alias("heading"), (wide | turned).alias("breaks"), slug(F.col("clean")).alias("slug")
    )


def following(level: int, label: str) -> str | None:
    """The label after a label of a level; None after the last one."""
    if level in (SECTION, IN_ROMAN):
        place = ROMANS.index(label.upper()) + 1 if label.upper() in ROMANS else len(ROMANS)
        after = ROMANS[place] if place < len(ROMANS) else None
        return after.lower() if after and level == IN_ROMAN else after
    if level in (NUMBER, IN_NUMBER):
        return str(int(label) + 1)
    return None if label in ("z", "Z") else chr(ord(label) + 1)


def readings(label: str, rest: str) -> list[tuple[int, str]]:
    """The levels that a written label can have, the likeliest first: (i) is a letter or the first roman numeral."""
    bare = label.strip("().")
    if label[0] == "(":
        if bare.isdigit():
            return [(IN_NUMBER, bare)]
        return [(IN_LOWER, bare)] * (len(bare) == 1) + [(IN_ROMAN, bare)] * (bare.upper() in ROMANS)
    if bare.isdigit():
        return [(NUMBER, bare)]
    if bare.islower():
        return [(LOWER, bare)]
    letters = [c for c in rest if c.isalpha()]
    titled = len(letters) >= 3 and all(c.isupper() for c in letters)
    roman = set(bare) <= set("IVX") and (len(bare) > 1 or titled)
    return [(SECTION if roman else UPPER, bare)]


FIRST = {SECTION: "I", UPPER: "A", NUMBER: "1", LOWER: "a", IN_NUMBER: "1", IN_LOWER: "a", IN_ROMAN: "i"}


@dataclass
class Open:
    """A clause that lines may still join."""

    node: int
    level: int
    core: str
    x: float
    kind: str  # label, heading or para
    path: str
    lines: int = 0
    parent: bool = False  # whether it has clauses below
    paragraphs: int = 0


class Automaton:
    """The chain of open clauses of one document; each line is told which clause it belongs to."""

    def __init__(self, strict: bool, root_paragraphs: bool):
        self.strict, self.root_paragraphs = strict, root_paragraphs
        self.chain: list[Open] = []
        self.count = self.paragraphs = 0

    def objection(self, level: int, core: str, x: float) -> str | None:
        """Why a label may not open a clause here; None if it may."""
        labelled = [o for o in self.chain if o.kind != "para"]
        same = [o for o in labelled if o.level == level and o.kind == "label"]
        if same:
            expected = following(level, same[-1].core)
            later = any(o.level < level for o in labelled[labelled.index(same[-1]) + 1 :])
            return None if core == expected or later and core == FIRST[level] else f"expected {expected}"
        if core != FIRST[level]:
            return None if level == SECTION and not labelled else "no open sequence"
        if labelled and labelled[-1].level != SECTION and x < labelled[-1].x - SLACK:
            return "left of its parent"
        return None

    def open(self, level: int, core: str, x: float, kind: str) -> Open:
        above = self.chain[-1] if self.chain else None
        label = f"({core})" if kind == "label" and level >= IN_NUMBER else core
        made = Open(self.count, level, core, x, kind, f"{above.path}.{label}" if above else label)
        if above:
            above.parent = True
        self.count += 1
        self.chain.append(made)
        return made

    def line(self, label: str, rest: str, x: float, heading: bool, breaks: bool, named: str) -> tuple[Open | None, bool, str | None]:
        """(the clause, whether the line opens it, a warning); no clause: the line is of the preamble."""
        warning = None
        if label:
            objections = []
            for level, core in readings(label, rest):
                against = self.objection(level, core, x) if self.strict else None
                if against is None:
                    while self.chain and (self.chain[-1].kind == "para" or self.chain[-1].level >= level):
                        self.chain.pop()
                    return self.open(level, core, x, "label"), True, None
                objections.append(f"rejected {core} at {LEVELS[level]} ({against})")
            warning = "; ".join(objections) or None
        elif heading:
            self.chain.clear()
            return self.open(SECTION, named, x, "heading"), True, None
        if not self.chain:
            if not self.root_paragraphs:
                return None, False, warning
            self.paragraphs += 1
            return self.open(PARAGRAPH, f"p{self.paragraphs}", x, "para"), True, warning
        top = self.chain[-1]
        bare = top.kind == "heading" and not top.parent and top.lines == 1
        if bare or breaks and (top.kind == "para" or top.level == SECTION):
            if top.kind == "para":
                self.chain.pop()
            above = self.chain[-1] if self.chain else self
            above.paragraphs += 1
            return self.open(PARAGRAPH, f"p{above.paragraphs}", x, "para"), True, warning
        outer = next((o for o in reversed(self.chain) if o.kind == "label" and o.x < x - SLACK), top)
        del self.chain[self.chain.index(outer) + 1 :]
        return outer, False, warning


def _placed(lines: DataFrame, strict: bool, root_paragraphs: bool) -> DataFrame:
    """lines with node, opens, ...: the clause of each line; node is null for the preamble.

    The documents of a partition follow each other, so that a task holds one batch of lines and one automaton at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, automaton = None, None
        for batch in batches:
            out = []
            for name, label, rest, x, heading, breaks, slug in zip(*(batch.column(c).to_pylist() for c in ("doc", "label", "rest", "rel_x", "heading", "breaks", "slug")), strict=True):
                if automaton is None or name != doc:
                    doc, automaton = name, Automaton(strict, root_paragraphs)
                clause, opens, warning = automaton.line(label, rest, x, heading, breaks, slug)
                if clause is None:
                    out.append((None, False, None, None, None, None, None, None, warning))
                    continue
                clause.lines += 1
                parent, _, own = clause.path.rpartition(".")
                out.append((clause.node, opens, clause.level, own, clause.path, parent or None, clause.kind, clause.x, warning))
            made = [pa.array(c, t) for c, t in zip(zip(*out), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + made, kept + names)

    names = [c.split(" ")[0] for c in _PLACED.split(", ")]
    kinds = [{"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}[c.split(" ")[1]] for c in _PLACED.split(", ")]
    kept = "doc n page col x0 y0 x1 y1 text rest clean rel_x".split()
    fields = lines.select(*kept, "label", "heading", "breaks", "slug").where("doc is not null and n is not null").repartition("doc").sortWithinPartitions("doc", "n")
    schema = ", ".join([f"{c} {fields.schema[c].dataType.simpleString()}" for c in kept] + [_PLACED])
    return fields.mapInArrow(run, schema)


@dataclass(frozen=True)
class Parsed:
    """clauses: (doc, ordinal, path, parent_path, level, label, heading, term, text, page_start, boxes); preambles: (doc, preamble); warnings: (doc, n, page, warning)."""

    clauses: DataFrame
    preambles: DataFrame
    warnings: DataFrame


def _boxes(lines: Column) -> Column:
    """One box for each run of lines (page, x0, y0, x1, y1) that follow each other in a column."""
    kind = "struct<page:int,x0:double,y0:double,x1:double,y1:double>"

    def step(acc: Column, new: Column) -> Column:
        last = acc.getField("last")
        runs_on = (last.page == new.page) & (F.abs(last.x0 - new.x0) < 60) & (new.y0 - last.y1 >= -8) & (new.y0 - last.y1 < 30)
        wider = F.struct(last.page.alias("page"), F.least(last.x0, new.x0).alias("x0"), F.least(last.y0, new.y0).alias("y0"), F.greatest(last.x1, new.x1).alias("x1"), F.greatest(last.y1, new.y1).alias("y1"))
        own = F.struct(*(new.getField(c).alias(c) for c in ("page", "x0", "y0", "x1", "y1")))
        return F.struct(F.when(runs_on | last.isNull(), acc.done).otherwise(F.concat(acc.done, F.array(last))).alias("done"), F.when(runs_on, wider).otherwise(own).alias("last"))

    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("last"))
    return F.aggregate(lines, start, step, lambda acc: F.concat(acc.done, F.array(acc.getField("last"))))


def parse(lines: DataFrame, strict: bool = True, root_paragraphs: bool = False) -> Parsed:
    """The clause trees of all documents.

    strict: a label opens a clause only where it is the next one of its list; amendments restate fragments, so they are
    read without. root_paragraphs: text before any section becomes paragraphs p1, p2, ... instead of the preamble.
    """
    told = described(lines)
    placed = _placed(told, strict, root_paragraphs)
    of_clause = placed.where("node is not null")
    said = F.when(F.col("opens") & (F.col("kind") == "label"), F.col("rest")).otherwise(F.col("text"))
    line = F.struct("n", said.alias("said"), "rel_x", "page", "x0", "y0", "x1", "y1")
    nodes = of_clause.groupBy("doc", "node").agg(
        *(F.first(F.when(F.col("opens"), F.col(c)), ignorenulls=True).alias(c) for c in ("level", "label", "path", "parent_path", "kind", "label_x")), F.min("n").alias("begin"), F.array_sort(F.collect_list(line)).alias("lines")
    )
    # what stands before the first clause below is a clause's own
    below = nodes.where("parent_path is not null").groupBy("doc", F.col("parent_path").alias("path")).agg(F.array_sort(F.collect_list("begin")).alias("births"))
    nodes = nodes.join(below, ["doc", "path"], "left").withColumn("child", F.get(F.filter("births", lambda b: b > F.col("begin")), F.lit(0)))
    own = F.when(F.col("child").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: x.n < F.col("child")))
    text_of = lambda c: cleaned(F.array_join(F.transform(c, lambda x: x.said), " "))
    nodes = nodes.withColumn("own", own).withColumn("text", text_of(F.col("lines"))).withColumn("head", text_of(F.col("own"))).withColumn("title", cleaned(F.col("lines")[0].said))
    short = F.length("title").between(1, 70) & ~F.col("title").rlike("[.;,:]$")
    alone = (F.size("own") == 1) | (F.get(F.col("lines"), F.lit(1)).rel_x <= F.col("label_x") + SLACK)
    heading = F.when((F.col("level") == SECTION) | (F.col("kind") == "heading") | ((F.col("kind") == "label") & short & alone), F.col("title"))
    nodes = nodes.withColumn("heading", heading).withColumn("top", F.substring_index("path", ".", 1))
    sections = nodes.where("parent_path is null").groupBy("doc", F.col("path").alias("top")).agg(F.max_by(F.contains(F.upper("title"), F.lit("DEFINITION")), "begin").alias("defines"))
    nodes = nodes.join(sections, ["doc", "top"], "left")
    numbered = F.coalesce(F.nullif(F.trim(F.regexp_extract("head", NUMBERED_TERM, 1)), F.lit("")), "heading")
    quoted = F.nullif(F.trim(F.regexp_extract("head", QUOTED_TERM, 1)), F.lit(""))
    term = F.when(F.col("defines") & (F.col("kind") == "label") & (F.col("level") == NUMBER), numbered).when(F.col("defines") & (F.col("kind") == "para"), quoted)
    clauses = nodes.select("doc", F.col("node").alias("ordinal"), "path", "parent_path", "level", "label", "heading", term.alias("term"), "text", F.col("lines")[0].page.alias("page_start"), _boxes(F.col("lines")).alias("boxes"))
    preambles = placed.where("node is null and clean <> ''").groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "clean"))), lambda x: x.clean), " ").alias("preamble"))
    return Parsed(clauses, preambles, placed.where("warning is not null").select("doc", "n", "page", F.concat_ws(": ", "warning", F.substring("text", 1, 60)).alias("warning")))


def by_path(clauses: DataFrame) -> DataFrame:
    """Clauses with one row for each path of a document: the last one."""
    return clauses.withColumn("_nth", F.row_number().over(Window.partitionBy("doc", "path").orderBy(F.desc("ordinal")))).where("_nth = 1").drop("_nth")
