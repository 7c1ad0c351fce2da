"""Made accounts through extraction, resolution, chunks, search, answers and measures."""

import datetime

import pytest
from pyspark.sql import functions as F

from clausewise.operators import answers, chunks, extraction, generators, metrics, ranking, relational, resolution, search

BASE = [
    ("I", 0, "I", "AGREEMENT", None, "AGREEMENT"), ("II", 0, "II", "DEFINITIONS", None, "DEFINITIONS"), ("II.C", 1, "C", None, None, "Terms used here:"),
    ("II.C.5", 2, "5", None, "Basement", "Basement. A room whose floor lies below the ground on all sides."), ("II.C.16", 2, "16", None, "Elevated Building", "Elevated Building. A building without basement, raised by piers."),
    ("III", 0, "III", "PROPERTY INSURED", None, "PROPERTY INSURED"), ("III.C", 1, "C", None, None, "Other coverages"), ("III.C.2", 2, "2", "Loss Avoidance", None, "Loss Avoidance"), ("III.C.2.a", 3, "a", None, None, "Measures"),
    ("III.C.2.a.(1)", 4, "(1)", None, None, "We will pay up to $1,000 for sandbags and what you spend to keep water out of a Basement."), ("IV", 0, "IV", "PROPERTY NOT INSURED", None, "PROPERTY NOT INSURED"), ("IV.14", 2, "14", None, None, "Hot tubs and swimming pools."),
]
FORM = "DWELLING@2021-10"


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """Plans of many small joins: one partition each."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def held(df):
    """A result as a table of its own, as a store would hold it: plans do not grow from step to step."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema).coalesce(1)


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([(FORM, i, *r) for i, r in enumerate(BASE)], "form string, ordinal int, path string, level int, label string, heading string, term string, text string").coalesce(1)


@pytest.fixture(scope="module")
def library(spark, base):
    clauses, forms = generators.library_clauses(spark)
    return clauses, forms, held(extraction.extract(clauses, forms, base))


@pytest.fixture(scope="module")
def accounts(spark):
    return held(generators.accounts(spark, 40, 7))


def test_accounts_are_the_same_for_a_seed_and_in_bounds(spark, accounts):
    rows = accounts.collect()
    assert rows[:5] == generators.accounts(spark, 5, 7).collect() and rows[:5] != generators.accounts(spark, 5, 8).collect()
    assert len({r.policy_number for r in rows}) == 40
    for r in rows:
        limits = {c.coverage: c.limit for c in r.coverages}
        assert limits["building"] <= 250_000 and limits.get("contents", 0) <= 100_000 and r.premium % 5 == 0
        assert (r.term_end - r.term_start).days in (364, 365)
        assert all(30 <= (c.effective - r.term_start).days <= 270 and c.new != c.old for c in r.changes)
        assert [(e.effective, e.form_id) for e in r.attached] == sorted((e.effective, e.form_id) for e in r.attached)
        assert len({e.form_id for e in r.attached}) == len(r.attached)
        assert all((e.form_id == "M-07") == bool(e["values"]) for e in r.attached)
    assert any(not r.attached for r in rows) and any({"M-01", "M-06"} <= {e.form_id for e in r.attached} for r in rows) and any(r.changes for r in rows)


def test_library_is_read_as_expected(spark, library):
    got = extraction.compared(generators.expected_operations(spark), library[2]).collect()
    assert [r.form for r in got if not r.matched] == []
    assert sorted(r.status for r in got) == ["held", *["resolved"] * 6, "unresolved"]
    rates = {r.form: r.rate for r in metrics.resolution_rate(library[2]).collect()}
    assert rates["M-01@2026-01"] == 1 and rates["M-08@2026-01"] == 0


def account(spark, attached, changes=(), contents=True, start=datetime.date(2026, 1, 1)):
    one = generators.accounts(spark, 1, 3).first().asDict(recursive=True)
    one |= {"account": "a", "policy_number": "NFP-2026-1234567", "term_start": start, "term_end": datetime.date(2026, 12, 31), "premium": 1200}
    one["coverages"] = [{"coverage": "building", "limit": 200000, "deductible": 2000}] + [{"coverage": "contents", "limit": 50000, "deductible": 1000}] * contents
    one["changes"] = [dict(zip(("number", "effective", "field", "old", "new", "reason"), c)) for c in changes]
    one["attached"] = [{"form_id": f, "edition": "2026-01", "title": f, "effective": d, "values": v} for f, d, v in attached]
    names = [c for c, _ in generators._columns()]
    return spark.createDataFrame([tuple(one[c] for c in names)], chunks.ACCOUNTS)


DAY = datetime.date


def test_values_lookup_and_term(spark):
    accounts = account(spark, [], [("G-1", DAY(2026, 3, 1), "building_limit", 200000, 250000, ""), ("G-2", DAY(2026, 3, 1), "building_limit", 250000, 150000, "")], contents=False)
    asked = [(1, "policy_number", None), (2, "building_limit", None), (3, "building_limit", DAY(2026, 2, 28)), (4, "building_limit", DAY(2026, 3, 1)), (5, "contents_limit", None), (6, "endorsement_change", None), (7, "annual_premium", None), (8, "unknown", None), (9, "term_end", None)]
    questions = spark.createDataFrame([(q, "a", f, d) for q, f, d in asked], "query_id long, account string, field string, as_of date")
    got = {r.query_id: (r.value, r.amount) for r in answers.declared(questions, accounts).collect()}
    assert got == {1: ("NFP-2026-1234567", None), 2: ("150000", 150000), 3: ("200000", 200000), 4: ("150000", 150000), 5: ("No contents coverage on this policy", None), 6: ("G-2, effective 2026-03-01", None), 7: ("1200", 1200), 9: ("2026-12-31", None)}
    dates = spark.createDataFrame([(1, "a", DAY(2025, 12, 31)), (2, "a", DAY(2026, 1, 1)), (3, "a", DAY(2026, 12, 31)), (4, "a", None)], "query_id long, account string, as_of date")
    assert {r.query_id: r.allowed for r in answers.in_term(dates, accounts).collect()} == {1: False, 2: True, 3: True, 4: True}
    table = generators.amended_table(accounts).collect()
    assert {(r.number, r.coverage, r.limit, r.deductible) for r in table} == {("G-1", "building", "$150,000", "$2,000"), ("G-2", "building", "$150,000", "$2,000")}


def test_declarations_text(spark):
    accounts = account(spark, [("M-07", DAY(2026, 2, 1), {"structures": "Barn"})], [("G-1", DAY(2026, 3, 1), "building_limit", 200000, 250000, "")], contents=False)
    got = {r.block: r.text for r in chunks.declarations(accounts).collect()}
    assert got["coverage"] == "Coverage and Deductibles. Building Property (Coverage A): limit of liability $200,000, deductible $2,000. Personal Property (Coverage B): not purchased. Total Annual Premium $1,200."
    assert got["forms"].endswith("M-07 2026-01 M-07, effective 2026-02-01. Schedule: structures: Barn G-1 General Change Endorsement effective 2026-03-01: the building limit is changed from $200,000 to $250,000.")
    assert "Policy Term 2026-01-01 to 2026-12-31" in got["policy"] and got["property"].startswith("Insured Property. Property Location ")


ATTACHED = [("M-01", DAY(2026, 1, 1), {}), ("M-02", DAY(2026, 1, 1), {}), ("M-03", DAY(2026, 4, 1), {}), ("M-05", DAY(2026, 4, 1), {}), ("M-06", DAY(2026, 4, 1), {}), ("M-07", DAY(2026, 1, 1), {"structures": "Barn"}), ("M-08", DAY(2026, 1, 1), {})]


@pytest.fixture(scope="module")
def resolved(spark, base, library):
    accounts = account(spark, ATTACHED)
    got = chunks.resolve_accounts(accounts, library[2], base)
    return accounts, resolution.Resolved(held(got.changed), held(got.held), held(got.unresolved))


def test_resolved_chunks(spark, base, library, resolved):
    accounts, got = resolved
    counts = chunks.resolution_counts(got).first()
    assert (counts.n_accounts, counts.n_changed, counts.n_conflicts, counts.n_held, counts.n_unresolved) == (1, 6, 0, 0, 1)
    rows = {(r.paths or [r.kind])[0]: r for r in chunks.build_chunks(accounts, "header", base, changed=got.changed).where("kind <> 'declarations'").collect()}
    assert rows["II.C.5"].text == "5. Basement. A room below the ground on all sides; a crawlspace is none. [As amended by endorsement M-01@2026-01 effective 2026-01-01, M-06@2026-01 effective 2026-04-01.]"
    assert rows["II.C.5"].header == f"{FORM} › DEFINITIONS › C › 5 Basement | modified by M-01@2026-01, M-06@2026-01"
    assert rows["IV.14"].text.startswith("[This clause is deleted by endorsement M-02@2026-01 effective 2026-01-01; it no longer applies") and not rows["IV.14"].active
    assert rows["IV.17"].text == "17. Solar panels that are not fixed to the building. [As amended by endorsement M-03@2026-01 effective 2026-04-01.]"
    assert rows["IV.17"].header == f"{FORM} › PROPERTY NOT INSURED › 17. (added by M-03@2026-01) | modified by M-03@2026-01"
    assert rows["IV.18"].text.startswith("18. These detached structures: Barn") and rows["unresolved"].text.startswith("[Unplaced endorsement text from M-08@2026-01;")
    order = [r.paths[0] for r in sorted(rows.values(), key=lambda r: r.ordinal) if r.paths]
    assert order == [p for p, *_ in BASE] + ["IV.18", "IV.17"]
    early = chunks.resolve_accounts(accounts, library[2], base, spark.createDataFrame([("a", DAY(2026, 3, 31))], "account string, as_of date"))
    texts = {r.path: r.text for r in early.changed.collect()}
    assert "three sides" in texts["II.C.5"] and "IV.17" not in texts and "III.C.2.a.(1)" not in texts


def test_window_and_clause_chunks(spark, base, library):
    accounts = account(spark, ATTACHED[:2]).unionByName(account(spark, []).withColumn("account", F.lit("b")))
    forms, spans = chunks.flat_forms(base)
    text = forms.first().text
    assert text.startswith("I. AGREEMENT\n\nII. DEFINITIONS\n\nC. Terms used here:") and "(1) We will pay" in text
    assert all(text[r.start : r.end].strip() for r in spans.collect())
    for variant in ("fixed", "recursive", "clause"):
        got = chunks.build_chunks(accounts, variant, base, library[0], library[1]).collect()
        assert {(r.account, r.kind) for r in got} == {("a", "clause"), ("a", "declarations"), ("a", "endorsement"), ("b", "clause"), ("b", "declarations")}
        assert len({r.chunk_id for r in got}) == len(got) and all(len(r.text) <= 2048 for r in got)
        assert {p for r in got if r.account == "b" for p in r.paths} == {p for p, *_ in BASE}
        assert sorted(r.ordinal for r in got if r.account == "a") == list(range(sum(r.account == "a" for r in got)))
    with pytest.raises(ValueError):
        chunks.build_chunks(accounts, "other", base)
    with pytest.raises(ValueError):
        chunks.build_chunks(accounts, "resolved", base)


@pytest.fixture(scope="module")
def index(spark, base, resolved):
    accounts, got = resolved
    other = account(spark, []).withColumn("account", F.lit("b"))
    made = chunks.build_chunks(accounts, "header", base, changed=got.changed).unionByName(chunks.build_chunks(other, "header", base, changed=got.changed.limit(0)))
    return held(search.build_index(held(made)))


def test_search_stays_in_the_account(spark, base, index):
    questions = spark.createDataFrame([(1, "a", "Does it pay for sandbags in the basement?"), (2, "b", "Does it pay for sandbags in the basement?"), (3, "none", "sandbags"), (4, "a", "")], "query_id long, account string, query string")
    owner = {r.chunk_id: (r.account, r.paths) for r in index.collect()}
    for config in (search.Config("dense"), search.Config("bm25"), search.Config("hybrid"), search.Config("hybrid", rerank=True, k=3, definitions=True)):
        hits = search.search(index, questions, config, base).collect()
        assert {r.query_id for r in hits} <= {1, 2, 4} and all(owner[r.chunk_id][0] == r.account for r in hits)
        for q in (1, 2):
            own = sorted((r for r in hits if r.query_id == q), key=lambda r: r.rank)
            assert [r.rank for r in own] == list(range(1, len(own) + 1)) and len(own) <= config.k + 2
            if config.mode != "dense":
                assert ["III.C.2.a.(1)"] in [owner[r.chunk_id][1] for r in own]
            if config.definitions:
                assert "rerank" in own[0].via
                covered = [owner[r.chunk_id][1] for r in own if r.via != "definition"]
                assert [owner[r.chunk_id][1] for r in own if r.via == "definition"] == [["II.C.5"]] * (["II.C.5"] not in covered)
    assert {owner[r.chunk_id][1][0] for r in search.full_text(index, questions.where("query_id < 3")).collect() if owner[r.chunk_id][1]} <= {"III.C.2.a.(1)"}


def test_fusion_names_its_lists(spark):
    one = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "z", 3)], "q int, item string, rank int")
    two = spark.createDataFrame([(1, "y", 1), (1, "w", 2)], "q int, item string, rank int")
    got = relational.fuse([one, two], ["q"], "item", names=["dense", "bm25"]).orderBy("rank").collect()
    assert [(r.item, r.via) for r in got] == [("y", "dense+bm25"), ("x", "dense"), ("w", "bm25"), ("z", "dense")]
    same = ranking.identity_order(one, ["q"]).orderBy("rank").collect()
    assert [r.score for r in same] == [3.0, 2.0, 1.0]


def with_chunks(index, base, config=search.Config("hybrid", rerank=True, k=3)):
    told = index.select("account", "chunk_id", "text", "said", "paths", "source", "lineage", "kind", "active", "header")
    return lambda asked: held(search.search(index, held(asked), config, base).join(told, ["account", "chunk_id"]))


def test_answers_are_looked_up_drafted_checked_and_withheld(spark, base, index, resolved):
    accounts = resolved[0]
    rows = [(1, "a", "What is the building deductible on policy NFP-2026-1234567?"), (2, "a", "What is the most it will pay up to for sandbags to keep water out?"), (3, "a", "Are zebras allowed on trampolines?"), (4, "b", "What is the building limit?")]
    questions = spark.createDataFrame(rows, "query_id long, account string, question string")
    find = with_chunks(index, base)
    got = {r.query_id: r for r in answers.answer(questions, accounts, find).collect()}
    assert (got[1].route, got[1].status, got[1].answer, got[1].numeric, got[1].citations[0].chunk_id) == ("declarations", "answered", "$2,000", 2000.0, "declarations:building_deductible")
    assert (got[2].route, got[2].status, got[2].numeric, got[2].citations[0].paths) == ("clause", "answered", 2500.0, ["III.C.2.a.(1)"]) or got[2].route == "mixed"
    assert got[3].status == "abstain" and got[3].reason.startswith("no retrieved clause mentions") and 4 not in got

    def made_up(asked, hits):
        """Drafts with a number or a claim that no hit carries, and one good claim beside a bad one."""
        best = hits.where("rank = 1").select("query_id", "chunk_id", "text")
        claim = lambda t: F.struct(t.alias("text"), F.array("chunk_id").alias("chunk_ids"))
        bad, good = F.lit("Zeppelins orbit Jupiter sideways."), F.col("text")
        claims = F.when(F.col("query_id") == 1, F.array(claim(good))).when(F.col("query_id") == 2, F.array(claim(bad))).otherwise(F.array(claim(good), claim(bad)))
        return best.select("query_id", F.lit(True).alias("can_answer"), F.lit("all of it").alias("answer"), claims.alias("claims"), F.when(F.col("query_id") == 1, 7.0).alias("numeric"), F.lit("").alias("missing"))

    asked = spark.createDataFrame([(i, "a", "Who pays for sandbags?") for i in (1, 2, 3)], "query_id long, account string, question string")
    got = {r.query_id: r for r in answers.answer(asked, accounts, find, made_up).collect()}
    assert [(got[i].status, got[i].grounded, got[i].numeric_ok) for i in (1, 2, 3)] == [("withheld", True, False), ("withheld", False, True), ("answered", True, True)]
    assert got[3].answer != "all of it" and len(got[3].claims) == 1 and got[1].reason.startswith("the amount 7")

    again = lambda asked, hits: asked.select("query_id", "account", F.lit("sandbags").alias("query"))
    looped = {r.query_id: r for r in answers.answer(questions.where("query_id in (2, 3)"), accounts, find, rewrite=again).collect()}
    assert looped[3].loop_used and not looped[2].loop_used


def test_context_enrichment_summary_and_examples(spark, base, index, resolved, library):
    accounts, got = resolved
    hits = index.where("account = 'a' and array_contains(paths, 'IV.14')").withColumn("query_id", F.lit(1)).withColumn("rank", F.lit(1))
    text = answers.context(hits).first().context
    assert "(clause IV.14; as amended by M-02@2026-01; DELETED clause, no longer applies)\n" in text
    cites = spark.createDataFrame([(1, "a", "x", ["IV.17"], FORM), (2, "a", "y", ["IV.14"], FORM), (3, "a", "declarations:f", [], "declarations"), (4, "a", "z", [], "M-08@2026-01")], "query_id int, account string, chunk_id string, paths array<string>, source string")
    full = base.withColumn("page_start", F.lit(4)).withColumn("boxes", F.array().cast("array<int>"))
    rows = {r.query_id: r for r in answers.enriched(cites, full, got.changed, FORM).collect()}
    assert [(rows[i].form, rows[i].page, rows[i].active) for i in (1, 2, 3, 4)] == [("M-03@2026-01", 1, True), (FORM, 4, False), ("declarations", 1, None), ("M-08@2026-01", 1, None)]
    assert rows[2].original_text == "Hot tubs and swimming pools."
    summary = answers.account_summary(accounts, got.changed).first()
    assert (summary.n_clauses_changed, summary.n_changes, len(summary.amendments)) == (6, 0, 7)
    shown = answers.examples(accounts, ["Is {policy} paid?"], generators.library(spark).select("form_id", "question")).first().examples
    assert shown[0] == "Is NFP-2026-1234567 paid?" and len(shown) == 8 and len(set(shown)) == 8 and any(q.endswith("as of 2026-03-31?") for q in shown)


def test_measures(spark):
    qa = spark.createDataFrame([(1, "x", ["p"], ["E"]), (2, "x", ["p"], []), (3, "y", [], ["E"]), (4, "y", None, None), (5, "y", ["q"], [])], "query_id long, difficulty string, expected_paths array<string>, expected_amendments array<string>")
    hits = [(1, 2, "clause", "F", "", ["p"], ["E", "G"], True), (1, 1, "clause", "F", "", ["o"], [], True), (2, 1, "clause", "F", "", ["p"], ["E"], True), (3, 3, "unresolved", "E", "", [], ["E"], True), (4, 1, "clause", "F", "", ["p"], [], True)]
    hits = spark.createDataFrame(hits, "query_id long, rank int, kind string, source string, text string, paths array<string>, lineage array<string>, active boolean")
    scored = metrics.per_question(qa, hits)
    assert {r.query_id: (r.hit, r.reciprocal, r.answered) for r in scored.collect()} == {1: (True, 0.5, True), 2: (True, 1.0, False), 3: (False, 0.0, True), 4: (False, 0.0, None), 5: (False, 0.0, False)}
    rungs = {r.difficulty: (r.n, r.hit_at_k, r.mrr, r.answer_at_k) for r in metrics.ladder_row(scored).collect()}
    assert rungs == {None: (5, 0.4, 0.3, 0.5), "x": (2, 1.0, 0.75, 0.5), "y": (3, 0.0, 0.0, 0.5)}
    qa = [(1, "money", "2500", ["p"]), (2, "text", "x" * 41 + " alpha beta gamma", ["p"]), (3, "abstain", "None", []), (4, "text", "short", []), (5, "abstain", "None", [])]
    qa = spark.createDataFrame([(i, "c", "d", t, a, p) for i, t, a, p in qa], "query_id long, category string, difficulty string, answer_type string, answer string, expected_paths array<string>")
    given = [(1, "answered", "We pay $2,500.", None, ["p"], False), (2, "answered", "alpha beta", None, ["o"], True), (3, "abstain", "", None, [], False), (4, "withheld", "short", None, [], False), (5, "answered", "yes", None, [], False)]
    given = spark.createDataFrame([(i, s, a, n, [("k", p, "", [], "")], u) for i, s, a, n, p, u in given], f"query_id long, status string, answer string, numeric double, citations {answers.CITATIONS}, loop_used boolean")
    scores = metrics.score_answers(qa, given).cache()
    assert {r.query_id: (r.exact, r.lexical, r.cite_hit, r.abstain_correct) for r in scores.collect()} == {1: (True, None, True, None), 2: (None, 0.5, False, None), 3: (None, None, None, True), 4: (False, None, None, None), 5: (None, None, None, False)}
    rates = metrics.answer_rates(scores).first()
    assert (rates.n, rates.exact, rates.lexical, rates.abstain_precision, rates.abstain_recall, rates.withheld_rate, rates.loop_rate, rates.cite_at_1) == (5, 0.5, 0.0, 1.0, 0.5, 0.2, 0.2, 0.5)
    assert metrics.by_category(scores).first().cite_n == 2
    assert metrics.report(metrics.ladder_row(scored).orderBy("difficulty"), "Ladder", {"k": "5"}, {"difficulty": "Kind", "mrr": "MRR"}).splitlines()[-1] == "| y | 0.000 |"


def test_question_sets(spark, accounts):
    known = generators.library(spark)
    rows = held(generators.declaration_questions(accounts).withColumn("query_id", F.monotonically_increasing_id()))
    facts = answers.declared(rows.select("query_id", "account", F.expr("CASE WHEN field = 'endorsements' THEN 'endorsement_change' ELSE field END").alias("field"), "as_of"), accounts)
    wrong = rows.join(facts.select("query_id", "value"), "query_id", "left").where("value is null or value <> answer").count()
    assert wrong == 0
    score = metrics.declarations_score(rows, facts).first()
    assert score.exact == score.routed >= 0.95 and score.n == rows.count()
    by_account = {r.account: r for r in accounts.collect()}
    asked = generators.amendment_questions(accounts, known).collect()
    for r in asked:
        forms = {e.form_id: e for e in by_account[r.account].attached}
        if r.difficulty == "negative":
            assert r.field not in forms and r.expected_amendments == []
        elif r.difficulty == "resolved":
            assert r.expected_amendments == [f"{r.field}@2026-01"] and "{" not in r.question + r.answer
        else:
            assert r.as_of == forms[r.field].effective - datetime.timedelta(days=1) and r.question.endswith(f"as of {r.as_of}?")
            rival = {"M-01": "M-06", "M-06": "M-01"}.get(r.field)
            assert (r.expected_amendments == [f"{rival}@2026-01"]) == (rival in forms and forms[rival].effective <= r.as_of)
    assert {r.difficulty for r in asked} == {"resolved", "as-of", "negative"}
    assert max(sum(r.difficulty == "negative" and r.account == a for r in asked) for a in by_account) <= 2
