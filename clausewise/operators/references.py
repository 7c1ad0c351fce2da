"""Written terms resolved to the clauses that define them, and the words of a reference. Built-ins and equi-joins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a reference that name nothing.
REFERENCE_STOP_WORDS = "the of this that in under to a an and or your our policy section paragraph clause subsection item provision form above below following endorsement part".split()
START = 3
#: Words that name a section by its usual title, and the shape of a written path.
SECTION_WORDS = {"condition": "CONDITION", "conditions": "CONDITION", "exclusion": "EXCLUSION", "exclusions": "EXCLUSION", "definition": "DEFINITION", "definitions": "DEFINITION", "deductible": "DEDUCTIBLE", "deductibles": "DEDUCTIBLE"}
PATH_TOKEN = r"^(?:[IVX]{1,5}|[A-Z]|\d{1,2}|[a-z]|\(\d{1,2}\)|\([a-z]{1,4}\))(?:\.(?:[A-Z]|\d{1,2}|[a-z]|\(\d{1,2}\)|\([a-z]{1,4}\)))*\.?$"
OF_POLICY = r"(?i)\b(of|in) (this|the) policy\b"


def singular(word: Column) -> Column:
    return F.when((F.length(word) > 3) & word.endswith("s"), F.regexp_replace(word, "s$", "")).otherwise(word)


def reference_words(reference: Column) -> Column:
    """Lower-case words of a reference in order, without those that name nothing."""
    return F.filter(F.regexp_extract_all(F.lower(reference), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(REFERENCE_STOP_WORDS))


def plain_term(term: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(term), "[^a-z0-9 ]", ""))


def resolve_terms(asked: DataFrame, clauses: DataFrame) -> DataFrame:
    """(term, path, confidence, alternates) for each distinct term of `asked`, against clauses (path, term).

    One clause that defines just this term: 0.95; several: no path, 0.3, all of them as alternates; else the only clause
    whose term contains it: 0.7; else no path, 0.0. A null or empty term, as one of punctuation alone, finds nothing.
    """
    terms = asked.select("term").distinct().withColumn("plain", F.nullif(plain_term(F.col("term")), F.lit("")))
    defined = clauses.where("term is not null").select("path", plain_term(F.col("term")).alias("known")).where("known <> ''")
    exact = terms.join(defined, F.col("plain") == F.col("known")).groupBy("term").agg(F.array_sort(F.collect_list("path")).alias("same"))
    # every start that a contained term can have: the pieces of at most START characters of a defined one
    places = F.sequence(F.lit(1), F.length("known"))
    pieces = F.array_distinct(F.flatten(F.transform(places, lambda i: F.transform(F.sequence(F.lit(1), F.lit(START)), lambda n: F.substring(F.col("known"), i, n)))))
    starts = defined.select("path", "known", F.explode(pieces).alias("start"))
    rest = terms.join(exact.select("term"), "term", "left_anti").withColumn("start", F.substring("plain", 1, START))
    partial = rest.join(starts, "start").where(F.contains("known", "plain")).groupBy("term").agg(F.count("*").alias("n"), F.min("path").alias("loose"))
    out = terms.join(exact, "term", "left").join(partial, "term", "left")
    one, several, alone = F.size("same") == 1, F.size("same") > 1, F.col("n") == 1
    return out.select(
        "term",
        F.when(one, F.get("same", F.lit(0))).when(several, None).when(alone, F.col("loose")).alias("path"),
        F.when(one, 0.95).when(several, 0.3).when(alone, 0.7).otherwise(0.0).alias("confidence"),
        F.when(several, F.col("same")).otherwise(F.array().cast("array<string>")).alias("alternates"),
    )


def path_tokens(reference: Column) -> Column:
    """The parts of a reference that are written as paths: they hold a digit, an inner dot, or are a roman numeral."""
    found = F.transform(F.regexp_extract_all(reference, F.lit(r"[A-Za-z0-9().]+"), F.lit(0)), lambda t: F.regexp_replace(t, r"\.+$", ""))
    return F.filter(found, lambda t: (t != "") & (t.rlike(r"\d") | F.contains(t, F.lit(".")) | t.rlike("^[IVX]{1,5}$")) & t.rlike(PATH_TOKEN))


def _words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), singular))


def resolve_refs(asked: DataFrame, clauses: DataFrame) -> DataFrame:
    """(form, ref, path, confidence, alternates) for each distinct written reference `ref` to a clause of its `form`.

    clauses: (form, ordinal, path, level, label, heading). The first that finds something decides: a path written out
    (0.95); a named section and a path below it (0.9); a path below one section only (0.7; below several: no path, 0.3);
    a heading that has all the words (0.85, 0.5 where another fits as well, three more as alternates); a section named
    without a path (0.8); else no path, 0.0. All steps are equi-joins within a form. A null or empty reference finds nothing.
    """
    refs = asked.select("form", "ref").distinct().withColumn("said", F.regexp_replace(F.regexp_replace(F.coalesce("ref", F.lit("")), OF_POLICY, ""), "^[ .:;,]+|[ .:;,]+$", ""))
    refs = refs.withColumn("tokens", path_tokens(F.col("said"))).withColumn("words", reference_words(F.col("said")))
    known = clauses.select("form", "ordinal", "path", "level", "label", "heading")
    paths = known.groupBy("form", "path").agg(F.max("ordinal").alias("ordinal"))
    key = ["form", "ref"]
    token = refs.select(*key, F.posexplode("tokens").alias("at", "token"))
    written = token.join(paths, (token.form == paths.form) & (token.token == paths.path)).select(token.form, "ref", "at", "path").groupBy(*key).agg(F.min_by("path", "at").alias("written"))

    sections = known.where("level = 0").withColumn("names", _words(F.coalesce(F.nullif("heading", F.lit("")), "label")))
    titles = F.array_distinct(F.array(*(F.lit(t) for t in SECTION_WORDS.values())))
    usual = F.transform(F.filter(titles, lambda t: F.startswith(F.col("label"), t)), lambda t: F.concat(F.lit("="), t))
    named = sections.select("form", F.col("path").alias("section"), F.col("ordinal").alias("place"), "names", F.explode(F.concat("names", usual)).alias("word"))
    spoken = refs.select(*key, "words", F.posexplode("words").alias("at", "w"))
    title_of = F.create_map(*(F.lit(x) for pair in SECTION_WORDS.items() for x in pair))
    spoken = spoken.select(*key, "words", "at", F.explode(F.array_compact(F.array(singular(F.col("w")), F.concat(F.lit("="), F.try_element_at(title_of, F.col("w")))))).alias("word"))
    hits = spoken.join(named, ["form", "word"]).groupBy(*key, "section", "place").agg(F.min("at").alias("at"), F.first(F.size(F.array_intersect("names", F.transform("words", singular)))).alias("share"))
    order = F.struct((-F.col("share")).alias("share"), "at", "place")
    by_name = hits.groupBy(*key).agg(F.min_by("section", order).alias("by_name"))
    below = hits.join(token.withColumnRenamed("at", "nth"), key).withColumn("path", F.concat_ws(".", "section", "token")).join(paths.select("form", "path"), ["form", "path"])
    below = below.groupBy(*key).agg(F.min_by("path", F.struct((-F.col("share")).alias("share"), "at", "place", "nth")).alias("below"))
    first = refs.where("size(tokens) > 0").select(*key, F.get("tokens", F.lit(0)).alias("token"))
    under = paths.select("form", "path", "ordinal", F.substring_index("path", ".", 1).alias("section")).join(sections.select("form", F.col("path").alias("section"), "ordinal").groupBy("form", "section").agg(F.min("ordinal").alias("place")), ["form", "section"])
    under = under.withColumn("token", F.expr("substring(path, length(section) + 2)")).where("token <> ''")
    anywhere = first.join(under, ["form", "token"]).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "path"))).alias("found"))
    anywhere = anywhere.select(*key, F.transform("found", lambda x: x.path).alias("anywhere"))

    titled = known.where("heading is not null and heading <> ''").withColumn("has", _words(F.col("heading")))
    want = refs.withColumn("want", F.array_distinct(F.transform(F.filter("words", lambda w: ~w.isin(list(SECTION_WORDS))), singular))).where("size(want) > 0")
    met = want.select(*key, "want", F.explode("want").alias("word")).join(titled.select("form", "ordinal", "path", "level", "has", F.explode("has").alias("word")), ["form", "word"])
    met = met.groupBy(*key, "ordinal", "path", "level").agg(F.count("*").alias("n"), F.first(F.size("want")).alias("needed"), F.first(F.size("has")).alias("long")).where("n = needed")
    ranked = met.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct((F.col("long") - F.col("n")).alias("extra"), "level", "ordinal", "path"))).alias("titled"))

    out = refs.select(*key, "tokens")
    for one in (written, below, anywhere, ranked, by_name):
        out = out.join(one, key, "left")
    best, second = F.get("titled", F.lit(0)), F.get("titled", F.lit(1))
    several, alone = F.size("anywhere") > 1, F.size("anywhere") == 1
    clear = second.isNull() | (best.extra < second.extra)
    section = F.col("by_name").isNotNull() & (F.size("tokens") == 0)
    path = F.coalesce("written", "below", F.when(alone, F.get("anywhere", F.lit(0))))
    choose = lambda a, b, c, d, e, none: F.when(F.col("written").isNotNull(), a).when(F.col("below").isNotNull(), a if b is None else b).when(alone | several, c).when(best.isNotNull(), d).when(section, e).otherwise(none)
    nothing = F.array().cast("array<string>")
    return out.select(
        *key, choose(path, None, path, best.path, F.col("by_name"), F.lit(None).cast("string")).alias("path"),
        choose(F.lit(0.95), F.lit(0.9), F.when(alone, 0.7).otherwise(0.3), F.when(clear, 0.85).otherwise(0.5), F.lit(0.8), F.lit(0.0)).alias("confidence"),
        choose(nothing, None, F.when(several, F.col("anywhere")).otherwise(nothing), F.transform(F.slice("titled", 2, 3), lambda x: x.path), nothing, nothing).alias("alternates"),
    )
