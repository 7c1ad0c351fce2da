"""The registered queries, each over its whole tables, beside the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.functions import text as T
from clausewise.functions.embed import embedded
from clausewise.operators import answers, chunking, clauses, extraction, generators, metrics, ranking, relational, resolution
from clausewise.streaming import limits

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("""SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n
FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00') WHERE n = 1""")
def asof_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value in force at a date, for each user and kind of event."""
    return relational.as_of(_table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", ["ts", "event_id"], F.col("ts") <= F.expr("timestamp_ntz'2024-01-15 00:00:00'"))


@_query("""SELECT user_id, as_of, value FROM (SELECT user_id, as_of, value, row_number() OVER (PARTITION BY user_id, as_of ORDER BY ts DESC, event_id DESC) AS n
FROM events JOIN (SELECT unnest([TIMESTAMP '2024-01-05 00:00:00', TIMESTAMP '2024-01-15 00:00:00', TIMESTAMP '2024-01-25 00:00:00']) AS as_of) ON ts <= as_of) WHERE n = 1""")
def asof_multi_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value in force at each of several dates."""
    dates = [f"2024-01-{d} 00:00:00" for d in ("05", "15", "25")]
    return relational.as_of_dates(_table(spark, sf_dir, "events"), dates, ["user_id"], "value", ["ts", "event_id"], "ts")


_KIND = "CASE event_type WHEN 'purchase' THEN 'REPLACE' WHEN 'error' THEN 'DELETE' WHEN 'signup' THEN 'AMEND' END"


@_query(f"""WITH o AS (SELECT *, {_KIND} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events WHERE event_type IN ('purchase', 'error', 'signup')),
l AS (SELECT user_id, max(seq) FILTER (kind = 'REPLACE') AS r, max(seq) FILTER (kind = 'DELETE') AS d, count(*) AS n FROM o GROUP BY user_id)
SELECT l.user_id, string_agg(CASE WHEN o.seq = l.r OR (o.kind = 'AMEND' AND o.seq > coalesce(l.r, 0)) THEN CAST(o.event_id AS VARCHAR) END, ' ' ORDER BY o.seq) AS text,
coalesce(l.d, 0) <= coalesce(l.r, 0) AS active, l.n FROM o JOIN l USING (user_id) GROUP BY l.user_id, l.r, l.d, l.n""")
def ordered_fold_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations folded in order on each user: purchases replace and revive, errors withdraw, signups append."""
    rows = _table(spark, sf_dir, "events").where("event_type in ('purchase', 'error', 'signup')").withColumn("kind", F.expr(_KIND))
    out = relational.fold(rows, ["user_id"], ["ts", "event_id"], "kind", "event_id")
    return out.withColumn("text", F.nullif("text", F.lit("")))


@_query("""SELECT a.user_id, a.event_id AS earlier, b.event_id AS later FROM events a JOIN events b
ON a.user_id = b.user_id AND CAST(a.ts AS DATE) = CAST(b.ts AS DATE) AND a.event_type <> b.event_type AND (a.ts, a.event_id) < (b.ts, b.event_id)
WHERE a.event_type IN ('purchase', 'error') AND b.event_type IN ('purchase', 'error')""")
def same_key_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of operations of different kinds on one key and day."""
    rows = _table(spark, sf_dir, "events").where("event_type in ('purchase', 'error')").select("user_id", "event_type", "event_id", "ts", F.to_date("ts").alias("day"))
    a, b = (rows.select("user_id", "day", F.col("event_type").alias(f"k{s}"), F.struct("ts", "event_id").alias(s)) for s in "ab")
    return a.join(b, ["user_id", "day"]).where("ka <> kb and a < b").select("user_id", F.col("a.event_id").alias("earlier"), F.col("b.event_id").alias("later"))


@_query("""SELECT c_custkey, coalesce(o.total, c_acctbal) AS amount, o.total IS NOT NULL AS changed FROM customer
LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS total FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey""")
def changed_vs_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rows overlaid with changed ones."""
    changed = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("total"))
    return _table(spark, sf_dir, "customer").join(changed, "c_custkey", "left").select("c_custkey", F.coalesce("total", "c_acctbal").alias("amount"), F.col("total").isNotNull().alias("changed"))


@_query("""SELECT doc_id, substr(sha1(doc_id || '|' || s), 1, 16) AS chunk_id, s AS start, least(s + 2048, n) AS "end", substr(text, s + 1, least(s + 2048, n) - s) AS chunk
FROM (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, unnest(range(0, CAST(greatest(0, ceil((length(text) - 2048) / 1792)) AS BIGINT) + 1)) * 1792 AS s FROM documents WHERE length(text) > 0)""")
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows of every document, with content-free ids."""
    return chunking.fixed_windows(_table(spark, sf_dir, "documents"), "doc_id", "text")


@_query("""SELECT conv_id, turn, CAST(s AS BIGINT) AS start, CAST(s + length(text) AS BIGINT) AS "end" FROM (SELECT *,
coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM conversations)""")
def flat_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of each turn in its conversation's flat text."""
    return chunking.flat_offsets(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "start", "end")


@_query("""WITH f AS (SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s, length(text) AS n FROM conversations),
w AS (SELECT conv_id, unnest(range(0, greatest(1, CAST(ceil(max(s + n) / 300) AS BIGINT)))) * 300 AS ws FROM f GROUP BY conv_id)
SELECT f.conv_id, turn, ws AS window_start FROM f JOIN w ON f.conv_id = w.conv_id AND s < ws + 350 AND s + n > ws WHERE n > 0""")
def window_span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which turns each window over a conversation's flat text covers: an interval overlap join on buckets."""
    spans = chunking.flat_offsets(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", F.col("start").alias("start_l"), F.col("end").alias("end_l"))
    count = F.greatest(F.lit(1), F.ceil(F.max("end_l") / 300)).cast("long")
    windows = spans.groupBy("conv_id").agg(count.alias("n")).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") - 1) * 300, F.lit(300).cast("long"))).alias("start_r")).withColumn("end_r", F.col("start_r") + 350)
    return relational.overlap_join(spans, windows, ["conv_id"], 350).select("conv_id", "turn", F.col("start_r").alias("window_start"))


@_query("""SELECT doc_id, i - 1 AS n, p AS paragraph FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(p) <> ''""")
def split_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.paragraphs(_table(spark, sf_dir, "documents"), "doc_id", "text")


@_query()
def recursive_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive splitting of every document; no SQL form."""
    return chunking.recursive_windows(_table(spark, sf_dir, "documents"), "doc_id", "text")


_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+(?:[.,][0-9]+)*')"


@_query(f"""SELECT source, doc_id, token, count(*) AS tf FROM (SELECT source, doc_id, unnest({_TOKENS}) AS token FROM documents) GROUP BY ALL""")
def token_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.postings(_table(spark, sf_dir, "documents"), "source", "doc_id", "text")


_BM25 = f"""p AS (SELECT source, doc_id, token, count(*) AS tf FROM (SELECT source, doc_id, unnest({_TOKENS}) AS token FROM documents) GROUP BY ALL),
len AS (SELECT source, doc_id, sum(tf) AS len FROM p GROUP BY ALL), st AS (SELECT source, count(*) AS n, avg(len) AS mean FROM len GROUP BY source),
raw AS (SELECT p.source, token, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p JOIN st USING (source) GROUP BY p.source, token),
mi AS (SELECT source, avg(raw) AS m FROM raw GROUP BY source), idf AS (SELECT source, token, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS idf FROM raw JOIN mi USING (source)),
q AS (SELECT item_id AS query_id, token, count(*) AS times FROM (SELECT item_id, unnest({_TOKENS}) AS token FROM benchmark) GROUP BY ALL),
s AS (SELECT query_id, p.source, p.doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score
FROM p JOIN q USING (token) JOIN idf ON idf.source = p.source AND idf.token = p.token JOIN len ON len.source = p.source AND len.doc_id = p.doc_id JOIN st ON st.source = p.source GROUP BY ALL),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5 AND score > 0)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.tokens(F.col("text"))).alias("token"))


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.bm25(_table(spark, sf_dir, "documents"), _asked(spark, sf_dir), "source", "doc_id", "text", 5)


@_query(f"WITH {_BM25} SELECT query_id, source, doc_id, score, rank FROM bm")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best documents of each source for each benchmark item."""
    return _bm25(spark, sf_dir).select("query_id", "source", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


_OVERLAP = """ov AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS rank FROM (
SELECT query_id, source, doc_id, count(DISTINCT p.token) AS score FROM p JOIN q USING (token) GROUP BY ALL)) WHERE rank <= 5)"""


def _overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.overlap(_table(spark, sf_dir, "documents"), _asked(spark, sf_dir), "source", "doc_id", "text", 5)


@_query(f"""WITH {_BM25}, {_OVERLAP}, u AS (SELECT query_id, source, doc_id, rank, 0 AS list FROM bm UNION ALL SELECT query_id, source, doc_id, rank, 1 FROM ov)
SELECT query_id, source, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, first, doc_id) AS rank FROM (
SELECT query_id, source, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list * 1000 + rank) AS first FROM u GROUP BY ALL)) WHERE rank <= 5""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and token-overlap rankings fused by reciprocal rank."""
    fused = relational.fuse([_bm25(spark, sf_dir), _overlap(spark, sf_dir)], ["query_id", "source"], "doc_id").where("rank <= 5")
    return fused.select("query_id", "source", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid ranking: the five best documents of each source for each benchmark item."""
    return rrf_fusion(spark, sf_dir)


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return vectors, vectors.where("vec_id % 50 = 0").select("label", F.col("vec_id").alias("query_id"), F.col("v").alias("query"))


def _dense_sql(score: str) -> str:
    return f"""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT label, vec_id AS query_id, v AS query FROM v WHERE vec_id % 50 = 0)
SELECT query_id, label, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS rank FROM (
SELECT query_id, v.label, vec_id, round({score}(v, query), 6) AS score FROM v JOIN q USING (label))) WHERE rank <= 5"""


@_query(_dense_sql("list_inner_product"))
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, asked = _vectors(spark, sf_dir)
    return ranking.dense(vectors, asked, "label", "vec_id", "v", 5).withColumn("rank", F.col("rank").cast("long"))


@_query(_dense_sql("list_cosine_similarity"))
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, asked = _vectors(spark, sf_dir)
    return ranking.dense(vectors, asked, "label", "vec_id", "v", 5, ranking.cosine).withColumn("rank", F.col("rank").cast("long"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _words(column: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({column}), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})))"


def _amounts(column: str) -> str:
    return f"list_transform(regexp_extract_all({column}, '{T.MONEY}'), lambda x: CAST(regexp_replace(x, '[$,\\s]', '', 'g') AS DOUBLE))"


@_query(f"""WITH {_BM25} SELECT query_id, source, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, former, doc_id) AS rank FROM (
SELECT query_id, bm.source, bm.doc_id, bm.rank AS former, CASE WHEN len({_words('b.text')}) = 0 THEN 0 ELSE round(len(list_intersect({_words('b.text')}, {_words('d.text')})) / len({_words('b.text')}), 6) END AS score
FROM bm JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = bm.doc_id)) WHERE rank <= 3""")
def candidates_then_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each ranking scored again by the share of the question's words that they have."""
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    met = _bm25(spark, sf_dir).drop("score").join(asked, "query_id").join(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    out = ranking.rerank(met, ["query_id", "source"], "doc_id", "query", "text", 3)
    return out.select("query_id", "source", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@_query("""SELECT sha1(text) AS content, min(doc_id) AS doc_id, count(*) AS n FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM documents c WHERE c.lang = 'en' AND c.text = d.text) GROUP BY sha1(text)""")
def content_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct contents that a cache, here the English documents, does not hold."""
    docs = _table(spark, sf_dir, "documents").select(F.sha1("text").alias("content"), "doc_id", "lang")
    return docs.join(docs.where("lang = 'en'").select("content").distinct(), "content", "left_anti").groupBy("content").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


#: RE2 has no look-ahead: "cover age" is no word of these tables.
_LANGUAGE_SQL = T.LANGUAGE.replace("(?! ?age)", "")


@_query("""SELECT conv_id, turn, CASE """ + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{n}'" for n, p in T.FIELDS) + f""" END AS field,
CASE WHEN regexp_matches(text, '(?i){"|".join(p for _, p in T.FIELDS)}') THEN CASE WHEN regexp_matches(text, '(?i){_LANGUAGE_SQL}') THEN 'mixed' ELSE 'declarations' END ELSE 'clause' END AS route FROM conversations""")
def route_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.field(F.col("text")).alias("field"), T.route(F.col("text")).alias("route"))


@_query(f"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i){T.POLICY_SCOPE}', 'the policy', 'g'), '{T.POLICY}', ' ', 'g'), '(?i){T.DATE_SCOPE}', ' ', 'g'), '\\s+', ' ', 'g'), ' ,?') || '?' AS query FROM conversations""")
def clean_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.retrieval_query(F.col("text")).alias("query"))


@_query(f"""WITH {_BM25} SELECT query_id, bm.doc_id, len({_words('b.text')}) = 0 OR len(list_intersect({_words('b.text')}, {_words('d.text')})) / len({_words('b.text')}) >= 0.5
AND len(list_filter({_amounts('b.text')}, lambda x: NOT list_contains({_amounts('d.text')}, x))) = 0 AS supported FROM bm JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = bm.doc_id""")
def supported_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each ranked document carries the benchmark item as a claim. SQL has no look-behind for the numbers of a claim: items have none."""
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("claim"))
    met = _bm25(spark, sf_dir).join(asked, "query_id").join(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return met.select("query_id", "doc_id", T.supported(F.col("claim"), F.col("text")).alias("supported"))


@_query(f"""WITH {_BM25}, j AS (SELECT query_id, min(rank) AS r FROM bm JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY query_id)
SELECT item_id % 4 AS kind, count(*) AS n, avg(CASE WHEN r IS NULL THEN 0.0 ELSE 1.0 END) AS hit, round(avg(coalesce(1.0 / r, 0)), 9) AS mrr FROM benchmark LEFT JOIN j ON query_id = item_id GROUP BY ROLLUP (item_id % 4)""")
def hit_mrr_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of hits and mean reciprocal rank of the first good document, by kind of question and overall; a question without one is a miss."""
    good = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    first = _bm25(spark, sf_dir).join(good, "doc_id", "left_semi").groupBy(F.col("query_id").alias("item_id")).agg(F.min("rank").alias("r"))
    asked = _table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 4).alias("kind")).join(first, "item_id", "left")
    return asked.rollup("kind").agg(F.count("*").alias("n"), F.avg(F.when(F.col("r").isNull(), 0.0).otherwise(1.0)).alias("hit"), F.round(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))), 9).alias("mrr"))


@_query("""SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, interpolated percentiles."""
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))


@_query(r"""SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || '.')), '[$,]', '', 'g'), '\.+$', '') AS name, regexp_replace(regexp_replace(lower(trim(p_name || '.')), '[$,]', '', 'g'), '\.+$', '') = lower(p_name) AS equal FROM part""")
def normalised_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = T.normalised(F.concat("p_name", F.lit(".")))
    return _table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), (name == F.lower("p_name")).alias("equal"))


@_query(r"""WITH l AS (SELECT source, doc_id, lower(regexp_replace(unnest(string_split(text, chr(10))), '[0-9]+', '#', 'g')) AS line FROM documents),
n AS (SELECT source, greatest(3, CAST(floor(0.05 * count(DISTINCT doc_id)) AS BIGINT)) AS least FROM l GROUP BY source)
SELECT l.source, line, count(DISTINCT doc_id) AS docs FROM l JOIN n USING (source) WHERE trim(line) <> '' GROUP BY l.source, line, least HAVING count(DISTINCT doc_id) >= least""")
def repeating_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, digits aside, that recur in many documents of a source: headers, footers, boilerplate."""
    lines = _table(spark, sf_dir, "documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line")).select("source", "doc_id", F.lower(F.regexp_replace("line", "[0-9]+", "#")).alias("line"))
    least = lines.groupBy("source").agg(F.greatest(F.lit(3), F.floor(0.05 * F.countDistinct("doc_id"))).alias("least"))
    counted = lines.where(F.trim("line") != "").distinct().groupBy("source", "line").agg(F.count("*").alias("docs"))
    return counted.join(least, "source").where("docs >= least").drop("least")


@_query("""SELECT c_custkey, r_name || ' > ' || n_name || ' > ' || c_name AS breadcrumb FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of names above each row."""
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    above = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_nationkey").alias("c_nationkey"), "r_name", "n_name")
    return _table(spark, sf_dir, "customer").join(above, "c_nationkey").select("c_custkey", F.concat_ws(" > ", "r_name", "n_name", "c_name").alias("breadcrumb"))


_PATH = "regexp_replace(url, '^[a-z]+://', '')"


@_query(f"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), h AS (SELECT DISTINCT string_split(path, '/')[1] AS host FROM p)
SELECT host, count(*) AS pages, max(length(path)) AS longest FROM h JOIN p ON path = host OR starts_with(path, host || '/') GROUP BY host""")
def prefix_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows below each parent path, by an equi-join on exploded ancestors."""
    rows = _table(spark, sf_dir, "pages").select("page_id", F.expr(_PATH).alias("path"))
    hosts = rows.select(F.split("path", "/")[0].alias("parent")).distinct()
    met = relational.subtree_join(hosts, rows, [], "/")
    return met.groupBy(F.col("parent").alias("host")).agg(F.count("*").alias("pages"), F.max(F.length("path")).cast("long").alias("longest"))


@_query(f"""WITH RECURSIVE a(page_id, path) AS (SELECT page_id, {_PATH} FROM pages UNION ALL SELECT page_id, regexp_replace(path, '/[^/]*$', '') FROM a WHERE contains(path, '/'))
SELECT path, count(DISTINCT page_id) AS pages FROM a GROUP BY path""")
def recursive_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages lie at or below each path."""
    rows = _table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(relational.ancestors(F.expr(_PATH), "/"))).alias("path"))
    return rows.groupBy("path").agg(F.countDistinct("page_id").alias("pages"))


@_query("""SELECT event_id, count(*) OVER w AS in_window, count(*) OVER w > 2 AS refused FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW)""")
def rate_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a user in the hour up to each one, and whether a limit of two refuses it."""
    return limits.rate_log(_table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3600, 2).select("event_id", "in_window", "refused")


@_query("SELECT user_id, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each user in hourly windows (an extension; the same function serves streams)."""
    return limits.windowed_counts(_table(spark, sf_dir, "events"), "user_id", "ts").withColumn("start", F.col("start").cast("timestamp_ntz"))


@_query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@_query("SELECT source, lang, count(*) AS n, avg(n_chars) AS mean_chars FROM documents GROUP BY source, lang")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean_chars"))


@_query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 40)""")
def first_n_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the first 40 accounts: the limit is the feature."""
    first = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")).orderBy("o_custkey").limit(40)
    return _table(spark, sf_dir, "orders").join(F.broadcast(first), "o_custkey", "left_semi").select("o_orderkey", "o_custkey", "o_totalprice")


@_query("""WITH b AS (SELECT user_id, arg_min(value, (ts, event_id)) AS value, arg_min(event_type, (ts, event_id)) AS kind FROM events WHERE event_type = 'signup' GROUP BY user_id),
c AS (SELECT user_id, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS kind FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT user_id, coalesce(c.value, b.value) AS value, coalesce(b.kind, c.kind) AS kind FROM b FULL JOIN c USING (user_id)""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest purchases merged into the first signups: the value is updated, the kind of an existing row stays."""
    events = _table(spark, sf_dir, "events")
    order = F.struct("ts", "event_id")
    current = events.where("event_type = 'signup'").groupBy("user_id").agg(F.min_by("value", order).alias("value"), F.min_by("event_type", order).alias("kind"))
    changes = events.where("event_type = 'purchase'").select("user_id", "value", F.col("event_type").alias("kind"), "event_id")
    return relational.upsert(current, changes, ["user_id"], ["value"], "event_id")


@_query("""SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def grouping_sets_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@_query(r"""SELECT doc_id, line, n FROM (SELECT doc_id, line, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, line) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY doc_id, line) WHERE k = 1""")
def most_repeated_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that each document repeats most."""
    lines = chunking.paragraphs(_table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("doc_id", F.col("paragraph").alias("line")).agg(F.count("*").alias("n"))
    return relational.top_k(lines, ["doc_id"], [F.desc("n"), F.col("line")], 1).drop("rank")


def _operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operations: a user is an account, a residue of the event the clause, another the amendment."""
    rows = _table(spark, sf_dir, "events").where("event_type in ('purchase', 'error', 'signup')")
    return rows.selectExpr(
        "cast(user_id as string) AS account", "cast(event_id as string) AS op_id", "cast(event_id % 3 as string) AS amendment", "'f' AS form", "cast(ts as date) AS effective", "0 AS ord", "event_id AS op_no",
        "CASE event_type WHEN 'purchase' THEN 'REPLACE' WHEN 'error' THEN 'DELETE' ELSE 'AMEND_DEF' END AS kind", "cast(event_id % 4 as string) AS path", "cast(event_id as string) AS text", "cast(null as string) AS label",
        "cast(null as array<struct<labels:array<string>,text:string>>) AS fragments", "'resolved' AS status", "cast(null as string) AS schedule_key", "cast(null as map<string,string>) AS values",
    )


@_query("""WITH o AS (SELECT user_id, event_id, CAST(ts AS DATE) AS day, event_id % 4 AS path, event_id % 3 AS amendment FROM events
WHERE event_type IN ('purchase', 'error', 'signup') AND CAST(ts AS DATE) <= DATE '2024-01-20')
SELECT CAST(a.user_id AS VARCHAR) AS account, CAST(a.path AS VARCHAR) AS path, CAST(a.event_id AS VARCHAR) AS earlier, CAST(b.event_id AS VARCHAR) AS later
FROM o a JOIN o b ON a.user_id = b.user_id AND a.path = b.path AND a.day = b.day AND a.amendment <> b.amendment AND a.event_id < b.event_id""")
def resolution_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts met while all operations in force at a date are folded on every account's clauses."""
    base = spark.range(4).selectExpr("cast(id as string) AS path", "cast(id as int) AS ordinal", "'base' AS text")
    got = resolution.resolve(_operations(spark, sf_dir), base, F.lit("2024-01-20").cast("date"))
    return got.changed.select("account", "path", F.explode("conflicts").alias("c")).select("account", "path", "c.earlier", "c.later")


@_query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 4 ORDER BY CAST(ts AS DATE), event_id) AS seq FROM events
WHERE event_type IN ('purchase', 'error', 'signup') AND CAST(ts AS DATE) <= DATE '2024-01-20'),
l AS (SELECT user_id, event_id % 4 AS path, coalesce(max(seq) FILTER (event_type = 'purchase'), 0) AS r, coalesce(max(seq) FILTER (event_type = 'error'), 0) AS d, count(*) AS n FROM o GROUP BY ALL)
SELECT CAST(l.user_id AS VARCHAR) AS account, CAST(l.path AS VARCHAR) AS path, l.d <= l.r AS active, l.n AS n_lineage,
CASE WHEN l.r = 0 THEN concat_ws(' ', 'base', string_agg(CASE WHEN o.event_type = 'signup' THEN CAST(o.event_id AS VARCHAR) END, ' ' ORDER BY o.seq))
ELSE string_agg(CASE WHEN o.seq = l.r OR (o.event_type = 'signup' AND o.seq > l.r) THEN CAST(o.event_id AS VARCHAR) END, ' ' ORDER BY o.seq) END AS text
FROM l JOIN o ON o.user_id = l.user_id AND o.event_id % 4 = l.path GROUP BY l.user_id, l.path, l.r, l.d, l.n""")
def resolution_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, state and length of lineage of every changed clause at a date."""
    base = spark.range(4).selectExpr("cast(id as string) AS path", "cast(id as int) AS ordinal", "'base' AS text")
    got = resolution.resolve(_operations(spark, sf_dir), base, F.lit("2024-01-20").cast("date"))
    return got.changed.select("account", "path", "active", F.size("lineage").cast("long").alias("n_lineage"), "text")


@_query("""WITH base AS (SELECT CAST(r_regionkey AS VARCHAR) AS path, r_regionkey * 100 AS anchor FROM region
UNION ALL SELECT n_regionkey || '.' || n_nationkey, n_regionkey * 100 + n_nationkey + 1 FROM nation)
SELECT path, CAST(anchor AS BIGINT) AS anchor, false AS added FROM base
UNION ALL SELECT path || '.' || s_suppkey, CAST(anchor AS BIGINT), true FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN base ON path = n_regionkey || '.' || n_nationkey""")
def resolution_materialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole form with its additions: regions and nations are clauses, suppliers are added below their nations."""
    nation = _table(spark, sf_dir, "nation")
    regions = _table(spark, sf_dir, "region").selectExpr("'f' AS base_form", "cast(r_regionkey as string) AS path", "cast(r_regionkey * 100 as int) AS ordinal", "r_name AS text")
    base = regions.unionByName(nation.selectExpr("'f' AS base_form", "concat_ws('.', n_regionkey, n_nationkey) AS path", "cast(n_regionkey * 100 + n_nationkey + 1 as int) AS ordinal", "n_name AS text"))
    ops = _table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(
        "'a' AS account", "cast(s_suppkey as string) AS op_id", "'x' AS amendment", "'F' AS form", "date'2024-01-01' AS effective", "0 AS ord", "cast(s_suppkey as bigint) AS op_no", "'ADD' AS kind",
        "concat_ws('.', n_regionkey, n_nationkey) AS path", "s_name AS text", "cast(s_suppkey as string) AS label", "cast(null as array<struct<labels:array<string>,text:string>>) AS fragments", "'resolved' AS status",
        "cast(null as string) AS schedule_key", "cast(null as map<string,string>) AS values",
    )
    changed = resolution.resolve(ops, base, F.lit("2024-01-01").cast("date")).changed
    accounts = ops.select("account", F.lit("f").alias("base_form"))
    return resolution.materialise(base, accounts, changed).select("path", "anchor", "added")


@_query(r"""WITH t AS (SELECT DISTINCT regexp_extract(lower(text), '[a-z]+ [a-z]+') AS term FROM benchmark),
d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS words FROM documents)
SELECT doc_id, term, place FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY length(term) DESC, term) AS place
FROM d JOIN t ON length(term) >= 4 AND contains(words, ' ' || term || ' ')) WHERE place <= 2""")
def pull_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two longest known terms that each document uses."""
    terms = _table(spark, sf_dir, "benchmark").select(F.regexp_extract(F.lower("text"), "[a-z]+ [a-z]+", 0).alias("term")).distinct()
    return ranking.definitions(_table(spark, sf_dir, "documents"), terms, "doc_id", "text")


@_query()
def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash embedder's vector of each benchmark passage."""
    return embedded(_table(spark, sf_dir, "benchmark"), "text").select("item_id", "embedding")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the lines of one-column pages: 12 points apart, 30 after a blank line."""
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc"), F.posexplode(F.split("text", "\n")).alias("n", "text")).where("trim(text) <> ''")
    y = F.col("n") * 12.0
    return rows.select("doc", F.col("n").cast("long").alias("n"), F.lit(1).alias("page"), F.lit(0).alias("col"), F.lit(50.0).alias("x0"), y.alias("y0"), F.lit(500.0).alias("x1"), (y + 10).alias("y1"), "text")


@_query()
def parsed_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as numbered forms, their paragraphs at the root; an automaton, so no SQL form."""
    found = clauses.parse(_lines(spark, sf_dir), strict=False, root_paragraphs=True).clauses
    return found.select("doc", "ordinal", "path", "parent_path", "level", "heading", F.length("text").cast("long").alias("n_chars"), F.sha1("text").alias("content"))


@_query()
def sentence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every benchmark passage; RE2 has no look-behind, so there is no SQL form."""
    rows = _table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(extraction.sentences(F.col("text"))).alias("n", "sentence"))
    return rows.select("item_id", F.col("n").cast("long").alias("n"), "sentence")


@_query()
def made_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One made account for each customer; hashes of the engine, so no SQL form."""
    n = _table(spark, sf_dir, "customer").count()
    made = generators.accounts(spark, n, 20_260_101)
    return made.select("account", "policy_number", "term_start", "term_end", "premium", F.size("coverages").cast("long").alias("n_coverages"), F.size("changes").cast("long").alias("n_changes"), F.size("attached").cast("long").alias("n_attached"))


@_query()
def declaration_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of made declaration questions that the lookup answers exactly, for one account for each customer."""
    made = generators.accounts(spark, _table(spark, sf_dir, "customer").count(), 20_260_101)
    asked = generators.declaration_questions(made).withColumn("query_id", F.xxhash64("account", "nth"))
    known = F.when(F.col("field") == "endorsements", "endorsement_change").otherwise(F.col("field"))
    return metrics.declarations_score(asked, answers.declared(asked.select("query_id", "account", known.alias("field"), "as_of"), made))


@_query("""SELECT CAST(event_type AS VARCHAR) AS form, count(*) AS n, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS rate FROM events GROUP BY event_type""")
def resolution_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of resolved operations of each amendment; events of a value above 50 stand for them."""
    ops = _table(spark, sf_dir, "events").select(F.col("event_type").alias("form"), F.when(F.col("value") > 50, "resolved").otherwise("held").alias("status"))
    return metrics.resolution_rate(ops)


@_query("""SELECT b.user_id, b.event_id, max(a.event_id) AS other FROM events b JOIN events a ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.ts < b.ts
AND NOT EXISTS (SELECT 1 FROM events c WHERE c.user_id = b.user_id AND c.event_type = b.event_type AND c.ts < b.ts AND (c.ts > a.ts OR (c.ts = a.ts AND c.event_id > a.event_id))) GROUP BY ALL""")
def latest_competitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event the latest earlier one of its user and kind."""
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("account"), F.col("event_id").alias("form_id"), F.col("ts").alias("effective"), F.lit(None).cast("string").alias("schedule"), F.col("event_type").alias("path"))
    attached, paths = rows.drop("path"), rows.select("form_id", "path", F.lit("").alias("answer"))
    return generators.competitor(attached, paths).select(F.col("account").cast("long").alias("user_id"), F.col("form_id").alias("event_id"), "other")


@_query(f"""WITH w AS (SELECT item_id, {_words('text')} AS q, text FROM benchmark), {_BM25},
d AS (SELECT query_id, doc_id, len(w.q) AS asked, len(list_intersect(w.q, {_words('d.text')})) AS matched, row_number() OVER (PARTITION BY query_id ORDER BY len(list_intersect(w.q, {_words('d.text')})) DESC, bm.rank, bm.source, bm.doc_id) AS k
FROM bm JOIN w ON w.item_id = query_id JOIN documents d USING (doc_id))
SELECT query_id, doc_id, asked > 0 AND matched / asked >= 0.15 AND (matched >= 2 OR (asked <= 2 AND matched >= 1)) AS can_answer FROM d WHERE k = 1""")
def extractive_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked document that has the most of each benchmark item's words, and whether they are enough for an answer."""
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    met = _bm25(spark, sf_dir).join(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    hits = met.select("query_id", F.format_string("%02d %s %012d", "rank", "source", "doc_id").alias("chunk_id"), "rank", "text")
    drafts = answers.drafts(asked, hits)
    best = relational.top_k(_matched(asked, hits), ["query_id"], [F.desc("matched"), F.col("chunk_id")], 1, "nth")
    return best.join(drafts.select("query_id", "can_answer"), "query_id").select("query_id", F.substring_index("chunk_id", " ", -1).cast("long").alias("doc_id"), "can_answer")


def _matched(asked: DataFrame, hits: DataFrame) -> DataFrame:
    words = F.size(F.array_intersect(T.content_words(F.col("question")), T.content_words(F.col("text"))))
    return asked.join(hits, "query_id").select("query_id", "chunk_id", words.alias("matched"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
