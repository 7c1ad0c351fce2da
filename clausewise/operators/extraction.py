"""Amendment prose read into operations on a base form: sentences, directives, captured fragments, targets, states.

Everything is built-ins over rows: a clause's text is cut into sentences, each sentence is told by an ordered table of
patterns, a running count of directives numbers the operations, and the sentences between a directive and the next one (or
a closing sentence) are its captured text. Targets meet the base by the joins of `references`.

Clauses have form, ordinal, path, text and page_start, in the order of ordinal; forms have form, form_id, base and
preamble. Defined results: a form without clauses and preamble gives one held operation, as does one without a directive;
null texts are empty; forms that no row of `forms` names give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.operators.references import resolve_refs, resolve_terms

#: The directives in the order in which they are tried: kind, pattern, what its groups hold, and what holds of it.
DIRECTIVES = [
    ("REPLACE", r"^(?:in\s+consideration\s+of[^,]{0,100},\s*)?(.{3,160}?)\s+(?:is|are)\s+(?:hereby\s+)?(?:deleted(?:\s+in\s+(?:its|their)\s+entirety)?\s+and\s+)?replaced\s+(?:by|with)\s+the\s+following\s*:?\s*(.*)$", "target inline", ""),
    ("DELETE", r"^(?:in\s+consideration\s+of[^,]{0,100},\s*)?(.{3,160}?)\s+(?:is|are)\s+(?:hereby\s+)?deleted(?:\s+in\s+(?:its|their)\s+entirety)?\s*\.?\s*$", "target", ""),
    ("DELETE", r"^(.{3,160}?)\s+(?:does|do|shall)\s+not\s+apply(?:\s+to\s+this\s+policy)?\s*\.?\s*$", "target", ""),
    (
        "ADD",
        r"^the\s+following\s+(?:(?:new\s+)?(?:section|paragraph|item|subsection|clause|exclusion|definition|condition|sentence)s?\s+([A-Za-z0-9()]{1,6}?)\.?\s+)?"
        r"(?:is|are)\s+added\s+(?:to|after|following|at\s+the\s+end\s+of)\s+([^:]{3,160}?)\s*(?::\s*(.*))?$",
        "label target inline",
        "",
    ),
    (
        "AMEND_DEF",
        r"^the\s+definition\s+of\s+[\u201c\"']?([^\u201d\"']{2,60}?)[\u201d\"']?(?:\s+(?:in|under|at)\s+(.{3,80}?))?\s+is\s+"
        r"(?:amended|changed|revised|expanded|modified)(?:\s+to\s+(?:include|read|add)(?:\s+the\s+following)?)?\s*:?\s*(.*)$",
        "term target inline",
        "",
    ),
    ("ADD", r"^(?:in\s+consideration\s+(?:of\s+)?.{0,100}?,\s*)?this\s+policy\s+is\s+(?:extended|modified|amended)\s+to\s+provide\s+(?:coverage\s+for\s+)?the\s+following(?:\s+coverage)?\s*:?\s*(.*)$", "inline", "implied"),
    ("ADD", r"^(?:this|the)\s+policy\s+is\s+(?:amended|changed|modified)\s+as\s+follows\s*:?\s*(.*)$", "inline", "loose"),
    ("ADD", r"^it\s+is\s+(?:hereby\s+)?agreed\s+that\s+(.+)$", "inline", "loose held"),
    ("ADD", r"^under\s+(.{3,80}?)(?:\s+of\s+this\s+policy)?,?\s+we\s+do\s+not\s+(?:cover|insure)\s+(.+)$", "target inline", ""),
    ("ADD", r"\bchanges\s+the\s+([A-Z][A-Za-z ,]{2,60}?)\s+section\b(?:,\s*([A-Z][A-Z ]{2,40}))?(.*)$", "target sub inline", "held"),
]
#: Sentences that end an operation, sentences that are headers, and where sentences end.
CLOSER = (
    r"(?i)^(all\s+other\s+(terms|provisions|conditions)|except\s+as\s+(specifically\s+|otherwise\s+)?(modified|provided|amended|stated)|the\s+coverage\s+provided\s+by\s+this|"
    r"this\s+endorsement\s+(applies|does\s+not|will\s+not|is\s+attached)|signed\b|nothing\s+(else|herein)|this\s+agreement\s+also\s+applies|named\s+insured\s*:|policy\s+number\s*:|"
    r"effective\s+date\s*:|attached\s+to\s+and\s+forming|dated\b)"
)
HEADER = r"(?i)^(endorsement\s+no\.?|edition\s+date|form\s+no\.?|effective\s*:|prescribed\s+by|texas\s+windstorm|windstorm\s+and\s+hail$)"
SENTENCE_END = r"(?<=[.:;!?])(?<!(?:^|\s)(?:[IVX]{1,5}|\d{1,2}|[A-Za-z]|No|Inc|Corp|St|vs|etc|Sec|Para|Art)\.)\s+(?=[A-Z\u201c\"(])"
LABEL_PART = r"^(?:[A-Za-z]|\d{1,2}|\([a-z0-9]{1,4}\)|[IVX]{1,5})$"
BLANK = "_{4,}"
SCHEDULE_LENGTH, BODY_LENGTH, DIRECTIVE_LENGTH = 400, 2000, 200
IMPLIED = "extensions of coverage"

OPS = (
    "form string, op_no long, kind string, ref string, term string, path string, label string, text string, fragments array<struct<labels:array<string>,text:string>>, "
    "schedule_key string, method string, confidence double, status string, notes array<string>, page int, directive string"
)


def sentences(text: Column) -> Column:
    """The sentences of a text; a label or an abbreviation before the blank does not end one."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


def directive(sentence: Column) -> Column:
    """The first directive that a sentence is, as a struct (kind, target, label, term, inline, implied, loose, held); null if none."""
    out = F
    for kind, pattern, groups, marks in DIRECTIVES:
        pattern = f"(?is){pattern}"
        part = {g: F.nullif(F.trim(F.regexp_extract(sentence, pattern, i + 1)), F.lit("")) for i, g in enumerate(groups.split())}
        none = F.lit(None).cast("string")
        target = F.nullif(F.regexp_replace(F.coalesce(part.get("sub", none), part.get("target", none)), r"^[ .:;,]+|[ .:;,]+$", ""), F.lit(""))
        said = F.struct(
            F.lit(kind).alias("kind"), target.alias("target"), *(part.get(g, none).alias(g) for g in ("label", "term", "inline")), *(F.lit(m in marks.split()).alias(m) for m in ("implied", "loose", "held"))
        )
        out = out.when(sentence.rlike(pattern), said)
    return out


def labels_of(path: Column) -> Column:
    """The parts of a path that are labels."""
    return F.filter(F.split(path, "[.]"), lambda p: p.rlike(LABEL_PART) & ~p.rlike(r"^p\d+$"))


def joined(fragments: Column) -> Column:
    """Fragments as one text, each with its last label."""
    last = lambda f: F.try_element_at(f.labels, F.lit(-1))
    label = lambda f: F.when(last(f).isNull(), "").when(F.startswith(last(f), F.lit("(")), last(f)).otherwise(F.concat(last(f), F.lit(".")))
    return F.trim(F.array_join(F.transform(fragments, lambda f: F.trim(F.concat(label(f), F.lit(" "), f.text))), " "))


def _captured(clauses: DataFrame) -> DataFrame:
    """(form, op_no, said, page, directive, fragments) of each directive with the text that it captures."""
    rows = clauses.select("form", "ordinal", "path", "page_start", F.posexplode(sentences(F.trim(F.coalesce("text", F.lit(""))))).alias("pos", "sentence"))
    rows = rows.where(~F.col("sentence").rlike(HEADER)).withColumn("said", directive(F.col("sentence")))
    order = Window.partitionBy("form").orderBy("ordinal", "pos")
    rows = rows.withColumn("op_no", F.count("said").over(order)).where("op_no > 0")
    within = Window.partitionBy("form", "op_no").orderBy("ordinal", "pos")
    closes = F.col("said").isNull() & F.col("sentence").rlike(CLOSER)
    rows = rows.withColumn("closed", F.max(closes).over(within)).withColumn("begin", F.first("ordinal").over(within)).where("not closed")
    opened = rows.where("said is not null").select("form", "op_no", "said", F.col("page_start").alias("page"), F.substring("sentence", 1, DIRECTIVE_LENGTH).alias("directive"))
    # the sentences of one clause are one fragment; behind a directive in the same clause they have no label of their own
    text = rows.where("said is null").groupBy("form", "op_no", "ordinal", "path", "begin").agg(F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("s"))
    labels = F.when(F.col("ordinal") == F.col("begin"), F.array().cast("array<string>")).otherwise(labels_of(F.col("path")))
    text = text.select("form", "op_no", "ordinal", F.struct(labels.alias("labels"), F.array_join(F.transform("s", lambda x: x.sentence), " ").alias("text")).alias("f"))
    text = text.groupBy("form", "op_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "f"))), lambda x: x.f).alias("rest"))
    inline = F.struct(F.array().cast("array<string>").alias("labels"), F.col("said.inline").alias("text"))
    first = F.when(F.col("said.inline").isNull(), F.expr("filter(array(cast(null as struct<labels:array<string>,text:string>)), x -> x is not null)")).otherwise(F.array(inline))
    none = F.expr("cast(array() as array<struct<labels:array<string>,text:string>>)")
    return opened.join(text, ["form", "op_no"], "left").withColumn("fragments", F.concat(first, F.coalesce("rest", none))).drop("rest")


def extract(clauses: DataFrame, forms: DataFrame, base: DataFrame) -> DataFrame:
    """The operations (OPS) of all amendments. base: clauses (form, ordinal, path, level, label, heading, term) of the forms that `forms.base` names."""
    known = forms.select("form", "form_id", "base", F.trim(F.coalesce("preamble", F.lit(""))).alias("preamble"))
    got = _captured(clauses).join(known, "form")
    implied = F.col("said.implied")
    got = got.select("form", "form_id", "base", "op_no", "page", "directive", "fragments", F.col("said.kind").alias("kind"), F.coalesce("said.target", F.when(implied, IMPLIED)).alias("ref"), F.col("said.term").alias("term"), F.col("said.label").alias("label"), implied.alias("implied"), F.col("said.loose").alias("loose"), F.col("said.held").alias("low"))
    got = got.withColumn("text", F.when(F.size("fragments") > 0, joined(F.col("fragments"))))
    defines = (F.col("kind") == "AMEND_DEF") & F.col("term").isNotNull()
    found_ref = resolve_refs(got.where("ref is not null").select(F.col("base").alias("form"), "ref"), base).select(F.col("form").alias("base"), "ref", F.col("path").alias("ref_path"), F.col("confidence").alias("ref_sure"), F.col("alternates").alias("others"))
    asked = got.where(defines).select("base", "term").distinct()
    found_term = _terms(asked, base)
    got = got.join(found_ref, ["base", "ref"], "left").join(found_term, ["base", "term"], "left")
    by_ref = F.col("ref").isNotNull() & (~defines | F.col("term_path").isNull())
    path = F.when(defines, F.coalesce("term_path", "ref_path")).otherwise(F.col("ref_path"))
    start = F.when(F.col("low"), 0.4).otherwise(0.0)
    sure = F.when(defines, F.greatest(start, F.when(F.col("term_path").isNull() & F.col("ref").isNotNull(), F.col("ref_sure")).otherwise(F.coalesce("term_sure", F.lit(0.0)))))
    sure = sure.when(F.col("ref").isNull(), start).when(start == 0, F.col("ref_sure")).when(F.col("ref_path").isNotNull(), F.least(start, F.col("ref_sure"))).otherwise(start)
    lacks = F.col("kind").isin("REPLACE", "ADD", "AMEND_DEF") & (F.coalesce("text", F.lit("")) == "")
    blanks = F.exists("fragments", lambda f: f.text.rlike(BLANK) & (F.length(f.text) <= SCHEDULE_LENGTH))
    labelled = F.get(F.filter("fragments", lambda f: F.size(f.labels) > 0), F.lit(0))
    got = got.withColumn("path", path).withColumn("confidence", F.round(F.when(lacks, F.least(sure, F.lit(0.3))).otherwise(sure), 2)).withColumn("schedule_key", F.when(blanks, F.col("form_id")))
    got = got.withColumn("label", F.coalesce("label", F.when(F.col("kind") == "ADD", F.get(labelled.labels, F.lit(0)))))
    unplaced = F.when(F.col("low"), "held").when((F.col("confidence") >= 0.3) | F.col("ref").isNotNull() | (F.col("kind") == "ADD"), "unresolved").otherwise("held")
    status = F.when(F.col("schedule_key").isNotNull(), "held").when(F.col("path").isNull(), unplaced).when(F.col("confidence") < 0.6, "held").otherwise("resolved")
    notes = F.array_compact(
        F.array(
            F.when(F.col("implied"), "target implied by the idiom"), F.when(F.col("loose"), "directive names no target clause"), F.when(F.col("low"), "low-confidence idiom; review before applying"),
            F.when(blanks, "text contains blanks to be filled from a schedule"), F.when(~blanks & F.coalesce(F.col("text").rlike(BLANK), F.lit(False)), "blanks in long text; not treated as a schedule"),
            F.when(by_ref & (F.size("others") > 0), F.concat(F.lit("alternates: "), F.array_join("others", ", "))), F.when(lacks, "no replacement text captured"),
        )
    )
    ops = got.select("form", "op_no", "kind", "ref", "term", "path", "label", "text", "fragments", "schedule_key", F.lit("rule").alias("method"), "confidence", status.alias("status"), notes.alias("notes"), "page", "directive")
    # forms in which no directive was found
    rest = known.join(ops.select("form").distinct(), "form", "left_anti")
    body = clauses.where(~F.coalesce("text", F.lit("")).rlike(HEADER)).groupBy("form").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x.text), " ").alias("body"))
    has = clauses.select("form").distinct().withColumn("has", F.lit(True))
    rest = rest.join(body, "form", "left").join(has, "form", "left")
    scanned = F.col("has").isNull() & (F.col("preamble") == "")
    none = F.lit(None).cast("string")
    held = rest.select(
        "form", F.lit(1).cast("long").alias("op_no"), F.lit("ADD").alias("kind"), none.alias("ref"), none.alias("term"), none.alias("path"), none.alias("label"),
        F.when(~scanned, F.substring(F.trim(F.coalesce("body", F.lit(""))), 1, BODY_LENGTH)).alias("text"), F.expr("cast(array() as array<struct<labels:array<string>,text:string>>)").alias("fragments"), none.alias("schedule_key"), F.lit("rule").alias("method"),
        F.lit(0.0).alias("confidence"), F.lit("held").alias("status"), F.array(F.when(scanned, "no extractable text; probably scanned").otherwise("no directive recognised")).alias("notes"), F.lit(1).alias("page"), F.lit("").alias("directive"),
    )
    return ops.unionByName(held)


def _terms(asked: DataFrame, base: DataFrame) -> DataFrame:
    """(base, term, term_path, term_sure): terms resolved within their own base form, whose name goes before both sides."""
    inside = lambda form, term: F.concat(F.regexp_replace(F.lower(form), "[^a-z0-9]", ""), F.lit("z"), term)
    plain = asked.withColumn("keyed", inside(F.col("base"), F.col("term")))
    # equality first, then containment, both by resolve_terms on one form at a time would not scale: the form is part of the key
    exact = resolve_terms(plain.select(F.col("keyed").alias("term")), base.where("term is not null").select("path", inside(F.col("form"), F.col("term")).alias("term")))
    return plain.join(exact.select(F.col("term").alias("keyed"), F.col("path").alias("term_path"), F.col("confidence").alias("term_sure")), "keyed").select("base", "term", "term_path", "term_sure")


def with_model(ops: DataFrame, forms: DataFrame, ask, schema: str = OPS) -> DataFrame:
    """ops, where forms without a resolved operation (and not scanned) have those that `ask` gives instead.

    ask: a function from an iterator of pandas frames of forms to one of operations, as mapInPandas takes; its
    confidences are held between 0 and 0.85, and what is below 0.6 or has no path is not resolved.
    """
    state = ops.groupBy("form").agg(F.max(F.col("status") == "resolved").alias("done"), F.max(F.array_contains("notes", "no extractable text; probably scanned")).alias("scanned"))
    open_forms = forms.join(state.where("not done and not scanned").select("form"), "form", "left_semi")
    made = open_forms.mapInPandas(ask, schema).withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.col("confidence"), F.lit(0.85))), 2)).withColumn("method", F.lit("model"))
    status = F.when(F.col("schedule_key").isNotNull(), "held").when(F.col("path").isNull(), "unresolved").when(F.col("confidence") < 0.6, "held").otherwise("resolved")
    made = made.withColumn("status", status)
    return ops.join(made.select("form").distinct(), "form", "left_anti").unionByName(made.select(*ops.columns))


def compared(expected: DataFrame, ops: DataFrame) -> DataFrame:
    """(form, nth, op_no, status, matched, n_ops): the first operation that meets each expectation.

    expected: (form, nth, kind, path, label, contains, schedule); a null path is expected to be null, other nulls ask nothing.
    """
    e, o = expected.alias("e"), ops.alias("o")
    meets = (
        (F.col("e.form") == F.col("o.form")) & (F.col("e.kind") == F.col("o.kind")) & F.col("e.path").eqNullSafe(F.col("o.path")) & (F.col("e.label").isNull() | (F.col("e.label") == F.col("o.label")))
        & (F.col("e.contains").isNull() | F.contains(F.coalesce("o.text", F.lit("")), F.col("e.contains"))) & (~F.coalesce("e.schedule", F.lit(False)) | F.col("o.schedule_key").isNotNull())
    )
    first = e.join(o, meets).groupBy("e.form", "e.nth").agg(F.min(F.struct("o.op_no", "o.status")).alias("hit"))
    counts = ops.groupBy("form").agg(F.count("*").alias("n_ops"))
    out = expected.select("form", "nth").join(first, ["form", "nth"], "left").join(counts, "form", "left")
    return out.select("form", "nth", "hit.op_no", "hit.status", F.col("hit").isNotNull().alias("matched"), F.coalesce("n_ops", F.lit(0)).alias("n_ops"))
