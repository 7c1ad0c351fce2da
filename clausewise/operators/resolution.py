"""Amendments applied to base clauses: an ordered, dated fold with lineage and conflicts, additions, and the whole text.

Operations have the columns of OPS; base clauses have path, ordinal and text. Everything is built-ins: operations meet
clauses by an equi-join on path, and one clause's operations of one account are folded in the JVM.

Defined results: a null effective date is earliest and always in force; operations on a path that neither the base nor
an applied addition has are unresolved and change nothing; empty inputs give empty results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.operators.relational import ancestors

OPS = (
    "account string, op_id string, amendment string, form string, effective date, ord int, op_no long, kind string, path string, text string, "
    "label string, fragments array<struct<labels:array<string>,text:string>>, status string, schedule_key string, values map<string,string>"
)
CHANGES = ("REPLACE", "DELETE", "AMEND_DEF")
BLANK = "_{4,}"
LINEAGE = "array<struct<op_id:string,amendment:string,kind:string,effective:date>>"
CONFLICTS = "array<struct<earlier:string,later:string,effective:date,before:string,after:string>>"


@dataclass(frozen=True)
class Resolved:
    """changed: (account, path, parent, base_text, text, active, added_by, lineage, conflicts, born, pos); held and unresolved: operations."""

    changed: DataFrame
    held: DataFrame
    unresolved: DataFrame


def in_force(ops: DataFrame, at: Column) -> DataFrame:
    """Operations effective on or before a date; those without a date always are."""
    return ops.where(F.col("effective").isNull() | (F.col("effective") <= at))


def filled(ops: DataFrame) -> DataFrame:
    """Blanks of operations with a schedule key: the first gets the key's value (else the first value), others go."""
    value = F.coalesce(F.nullif(F.try_element_at("values", F.col("schedule_key")), F.lit("")), F.get(F.map_values("values"), F.lit(0)))
    fills = F.col("schedule_key").isNotNull() & (F.coalesce(F.size("values"), F.lit(0)) > 0)

    def fill(text: Column) -> Column:
        at = F.regexp_instr(text, F.lit(BLANK))
        put = F.concat(F.substring(text, F.lit(1), at - 1), F.col("_value"), F.regexp_replace(F.substring(text, at, F.length(text)), BLANK, ""))
        return F.when(F.col("_value").isNull(), text).otherwise(F.trim(F.when(at > 0, put).otherwise(text)))

    out = ops.withColumn("_value", F.when(fills, F.nullif(value, F.lit(""))))
    return (
        out.withColumn("status", F.when(fills & F.col("path").isNotNull(), "resolved").otherwise(F.col("status")))
        .withColumn("text", fill(F.col("text")))
        .withColumn("fragments", F.transform("fragments", lambda f: F.struct(f.labels.alias("labels"), fill(f.text).alias("text"))))
        .drop("_value")
    )


def restated() -> Column:
    """The fragment that restates the target's own label, with the fragments below it; else the whole captured text."""
    own = F.try_element_at(F.split("path", "[.]"), F.lit(-1))
    match = F.get(F.filter("fragments", lambda f: F.try_element_at(f.labels, F.lit(-1)) == own), F.lit(0))
    deep = F.size(match.labels)
    kin = F.filter("fragments", lambda f: (F.size(f.labels) > deep) & (F.slice(f.labels, F.lit(1), deep) == match.labels))
    parts = F.transform(kin, lambda f: F.concat_ws(" ", F.try_element_at(f.labels, F.lit(-1)), f.text))
    return F.when(match.isNull(), F.col("text")).otherwise(F.trim(F.concat_ws(" ", match.text, parts)))


def _mark(op: Column) -> Column:
    return F.struct(*(op.getField(c).alias(c) for c in ("op_id", "amendment", "kind", "effective")))


def _step(acc: Column, op: Column) -> Column:
    prior = F.filter(acc.lineage, lambda x: x.effective.eqNullSafe(op.effective) & (x.amendment != op.amendment) & x.kind.isin(*CHANGES))
    after = F.coalesce(op.text, F.lit(""))
    met = F.transform(prior, lambda x: F.struct(x.op_id.alias("earlier"), op.op_id.alias("later"), op.effective.alias("effective"), acc.text.alias("before"), after.alias("after")))
    return F.struct(
        F.when(op.kind == "REPLACE", F.coalesce(F.nullif(op.restated, F.lit("")), acc.text))
        .when(op.kind == "AMEND_DEF", F.trim(F.concat_ws(" ", F.rtrim(acc.text), op.text)))
        .otherwise(acc.text).alias("text"),
        F.when(op.kind == "REPLACE", F.lit(True)).when(op.kind == "DELETE", F.lit(False)).otherwise(acc.active).alias("active"),
        F.concat(acc.lineage, F.array(_mark(op))).alias("lineage"),
        F.concat(acc.conflicts, met).alias("conflicts"),
    )


def additions(adds: DataFrame, base: DataFrame) -> DataFrame:
    """The rows that ADD operations make: (account, path, parent, text, added_by, lineage, born, pos), one for each path.

    Each labelled fragment is a row, unlabelled ones continue the one before; a fragment that only restates the target's
    own label chain is left out. A path that the base or an earlier amendment has gets '+form'; the same amendment
    writes over its own.
    """
    one = F.array(F.struct(F.when(F.col("label").isNull(), F.array().cast("array<string>")).otherwise(F.array("label")).alias("labels"), F.coalesce("text", F.lit("")).alias("text")))
    parts = adds.withColumn("fragments", F.when(F.coalesce(F.size("fragments"), F.lit(0)) > 0, F.col("fragments")).otherwise(one))
    parts = parts.select("*", F.posexplode("fragments").alias("pos", "f"))
    bare = F.coalesce(F.size("f.labels"), F.lit(0)) == 0
    labels = F.when(bare, F.array(F.coalesce("label", F.lit("+")))).otherwise(F.col("f.labels"))
    crumb = F.col("label").isNotNull() & ~bare & (F.get(labels, F.lit(0)) != F.col("label")) & (F.size(labels) == 1) & F.array_contains(F.split("path", "[.]"), F.get(labels, F.lit(0)))
    inside = Window.partitionBy("account", "op_id").orderBy("pos")
    parts = parts.withColumn("labels", labels).withColumn("bare", bare).withColumn("crumb", crumb)
    parts = parts.withColumn("made", F.sum(F.when(~F.col("bare") & ~F.col("crumb"), 1).otherwise(0)).over(inside)).where("not crumb")
    keys = ["account", "op_id", "amendment", "form", "kind", "effective", "ord", "op_no", "path", "label", "made"]
    rows = parts.groupBy(*keys).agg(F.min_by("labels", "pos").alias("labels"), F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "f.text"))).alias("texts"))
    rows = rows.withColumn("text", F.trim(F.array_join(F.transform("texts", lambda t: t.text), " ")))
    chain = F.when(F.col("label").isNull() | (F.get("labels", F.lit(0)) == F.col("label")), F.col("labels")).otherwise(F.concat(F.array("label"), "labels"))
    rows = rows.withColumn("parent", F.col("path")).withColumn("path", F.concat_ws(".", "path", F.array_join(chain, ".")))
    lost = adds.join(rows.select("account", "op_id").distinct(), ["account", "op_id"], "left_anti")  # all fragments were crumbs
    lost = lost.select(*keys[:8], F.concat_ws("", "path", F.lit(".+"), "form").alias("path"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("pos"))
    rows = rows.withColumn("born", F.struct("effective", "ord", "op_no"))
    first = Window.partitionBy("account", "path").orderBy("born", "pos")
    rows = rows.withColumn("owner", F.first("amendment").over(first)).join(base.select("path", F.lit(True).alias("known")), "path", "left")
    clash = F.coalesce("known", F.lit(False)) | (F.col("owner") != F.col("amendment"))
    rows = rows.withColumn("path", F.when(clash, F.concat_ws("+", "path", "form")).otherwise(F.col("path"))).select(*keys[:8], "path", "text", "pos")
    rows = rows.unionByName(lost).withColumn("born", F.struct("effective", "ord", "op_no"))
    last = rows.groupBy("account", "path").agg(F.max_by(F.struct("text", "amendment", "op_id", "kind", "effective", "born", "pos"), F.struct("born", "pos")).alias("r"))
    parent = F.regexp_replace("path", r"\.[^.]*$", "")
    return last.select("account", "path", parent.alias("parent"), "r.text", F.col("r.amendment").alias("added_by"), F.array(_mark(F.col("r"))).alias("lineage"), "r.born", "r.pos")


def resolve(ops: DataFrame, base: DataFrame, at: Column) -> Resolved:
    """Operations in force at a date, applied in the order of (effective, ord, op_no) to each account's clauses."""
    live = filled(in_force(ops, at))
    held = live.where("status = 'held'")
    rest = live.where("status is null or status <> 'held'")
    lone = F.coalesce(F.col("status") == "unresolved", F.lit(False)) | F.col("path").isNull()
    astray, placed = rest.where(lone), rest.where(~lone)
    roots = base.select("path", F.col("text").alias("base_text"))
    adds = additions(placed.where("kind in ('ADD', 'SCHEDULE')").join(roots.select("path"), "path", "left_semi"), base)

    born = F.struct("effective", "ord", "op_no")
    touching = placed.where(F.col("kind").isin(*CHANGES)).withColumn("restated", restated())
    op = F.struct("effective", "ord", "op_no", "op_id", "amendment", "kind", "text", "restated")
    grouped = touching.groupBy("account", "path").agg(F.array_sort(F.collect_list(op)).alias("ops"))
    none = (F.array().cast(LINEAGE).alias("lineage"), F.array().cast(CONFLICTS).alias("conflicts"))
    on_base = grouped.join(roots, "path").select("account", "path", F.regexp_replace("path", r"\.?[^.]*$", "").alias("parent"), "base_text", F.col("base_text").alias("text"), F.lit(None).cast("string").alias("added_by"), none[0], F.lit(None).cast("struct<effective:date,ord:int,op_no:bigint>").alias("born"), F.lit(0).alias("pos"), "ops")
    later = F.filter("ops", lambda x: F.struct(x.effective, x.ord, x.op_no) > F.col("born"))
    on_added = adds.join(grouped, ["account", "path"], "left").select("account", "path", "parent", F.lit(None).cast("string").alias("base_text"), "text", "added_by", "lineage", "born", "pos", F.coalesce(later, F.array().cast(grouped.schema["ops"].dataType)).alias("ops"))
    count = F.row_number().over(Window.partitionBy("account").orderBy(born))
    stray = astray.select("account", F.concat_ws(".", F.lit("UNRESOLVED"), "amendment", count.cast("string")).alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("base_text"), F.coalesce("text", F.lit("")).alias("text"), F.col("amendment").alias("added_by"), F.array(F.struct("op_id", "amendment", "kind", "effective")).alias("lineage"), born.alias("born"), F.lit(0).alias("pos"), F.array().cast(grouped.schema["ops"].dataType).alias("ops"))
    start = F.struct("text", F.lit(True).alias("active"), F.col("lineage").cast(LINEAGE).alias("lineage"), none[1])
    every = on_base.unionByName(on_added).unionByName(stray).withColumn("state", F.aggregate("ops", start, _step))
    changed = every.select("account", "path", "parent", "base_text", "state.text", "state.active", "added_by", "state.lineage", "state.conflicts", "born", "pos")
    known = roots.select("path").distinct()
    unknown = placed.join(known, "path", "left_anti").join(adds.select("account", "path"), ["account", "path"], "left_anti")
    unknown = unknown.unionByName(placed.where("kind in ('ADD', 'SCHEDULE')").join(known, "path", "left_anti").join(adds.select("account", "path"), ["account", "path"], "left_semi"))
    return Resolved(changed, held, astray.unionByName(unknown.select(*astray.columns)))


def materialise(base: DataFrame, accounts: DataFrame, changed: DataFrame) -> DataFrame:
    """Every clause of each account as amended: (account, path, text, active, added_by, lineage, anchor, added, born, pos).

    accounts: (account, base_form); base with base_form besides. Read in the order of (anchor nulls last, added, born, pos): an addition follows the last clause below its parent, or
    below its nearest ancestor of the base; those without one come last.
    """
    of_base = changed.where("added_by is null").select("account", "path", F.col("text").alias("new_text"), F.col("active").alias("on"), "lineage")
    own = accounts.select("account", "base_form").distinct().join(base.select("base_form", "path", "ordinal", "text"), "base_form").join(of_base, ["account", "path"], "left")
    born = "struct<effective:date,ord:int,op_no:bigint>"
    kept = own.select("account", "path", F.coalesce("new_text", "text").alias("text"), F.coalesce("on", F.lit(True)).alias("active"), F.lit(None).cast("string").alias("added_by"), "lineage", F.col("ordinal").cast("long").alias("anchor"), F.lit(False).alias("added"), F.lit(None).cast(born).alias("born"), F.lit(0).alias("pos"))
    ends = base.select(F.explode(ancestors(F.col("path"), ".")).alias("above"), "ordinal").groupBy("above").agg(F.max("ordinal").cast("long").alias("end"))
    new = changed.where("added_by is not null")
    above = new.where("parent is not null").select("account", "path", F.posexplode(ancestors(F.col("parent"), ".")).alias("depth", "above")).join(ends, "above")
    anchors = above.groupBy("account", "path").agg(F.max_by("end", "depth").alias("anchor"))
    placed = new.join(anchors, ["account", "path"], "left").select("account", "path", "text", "active", "added_by", "lineage", "anchor", F.lit(True).alias("added"), "born", "pos")
    return kept.unionByName(placed)
