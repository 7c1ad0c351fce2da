"""Ranked retrieval inside a tenant: postings, BM25, dense scores, reranking, definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.functions.text import content_words, tokens
from clausewise.operators.relational import top_k

#: So many rows of asked tokens are sent to every task (some 100 bytes each).
FEW = 1_000_000


def postings(docs: DataFrame, tenant: str, key: str, text: str) -> DataFrame:
    """(tenant, key, token, tf)."""
    return docs.select(tenant, key, F.explode(tokens(F.col(text))).alias("token")).groupBy(tenant, key, "token").agg(F.count("*").alias("tf"))


def _vocabulary(docs: DataFrame, tenant: str, text: str) -> DataFrame:
    """(tenant, token, c): how many documents of a tenant have each token; '' counts the documents, a zero byte their tokens.

    One column and no null, as plans that need less of two or filter one side would not share the exchange.
    """
    found = docs.where(F.col(text).isNotNull() & F.col(tenant).isNotNull()).select(tenant, tokens(F.col(text)).alias("found"))
    rows = found.select(tenant, F.size("found").cast("long").alias("len"), F.concat(F.array(F.lit(""), F.lit("\0")), F.array_distinct("found")).alias("found")).select(tenant, "len", F.explode_outer("found").alias("token")).where("token is not null")
    return rows.select(tenant, "token", F.when(F.col("token") == "\0", F.col("len")).otherwise(1).alias("w")).groupBy(tenant, "token").agg(F.sum("w").alias("c"))


def few(rows: DataFrame, times: int = 1) -> bool:
    """Whether each task can hold the rows `times` over; it reads them, so it is for questions, not for documents."""
    return rows.limit(FEW // times + 1).count() <= FEW // times


def said_words(docs: DataFrame, tenant: str, key: str, text: str) -> DataFrame:
    """(tenant, key, len, token): a row for each token of a document, all rows of a document in one partition.

    Texts are exchanged instead of their tokens, so that nothing grouped by document is exchanged again. The tokens are a
    column of their own before they are counted and exploded: else each row would find them anew. An outer explode, as a
    plain one has its texts split a second time before the exchange, to drop those without tokens.
    """
    whole = docs.where(F.col(text).isNotNull() & F.col(tenant).isNotNull()).select(tenant, key, text).repartition(tenant, key)
    found = whole.select(tenant, key, tokens(F.col(text)).alias("found")).select(tenant, key, F.size("found").alias("len"), "found")
    return found.select(tenant, key, "len", F.explode_outer("found").alias("token")).where("token is not null")


def bm25(docs: DataFrame, queries: DataFrame, tenant: str, key: str, text: str, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(query_id, tenant, key, score, rank): queries against tenants, top k by score, scores above 0 only.

    queries: (query_id, token) with repeats, for every tenant; or (query_id, tenant, token) for that tenant only.
    Statistics are per tenant; a negative idf becomes epsilon times the tenant's mean idf. Documents are read twice: for
    the vocabulary, whose one exchange serves the counts, the idf and its mean, and for the rows of asked tokens, which
    bring the length of their document along. The weights of asked tokens (query, tenant, token) are sent to every task if
    they are few, so that a document's scores are summed where its text lies; else both sides are exchanged. Documents
    without text or tenant are left out.
    """
    every = _vocabulary(docs, tenant, text)
    stats = every.groupBy(tenant).agg(F.max(F.when(F.col("token") == "", F.col("c"))).alias("n"), F.max(F.when(F.col("token") == "\0", F.col("c"))).alias("total"))
    raw = F.when(~F.col("token").isin("", "\0"), F.log(F.col("n") - F.col("c") + 0.5) - F.log(F.col("c") + 0.5))
    rated = every.join(stats, tenant).select(tenant, "token", raw.alias("raw"))
    of_tenant = rated.groupBy(tenant).agg(F.avg("raw").alias("mean_idf")).join(stats.select(tenant, (F.col("total") / F.col("n")).alias("mean")), tenant)
    own = [tenant] if tenant in queries.columns else []
    asked = queries.groupBy("query_id", *own, "token").agg(F.count("*").alias("times"))
    tenants = 1 if own else max(1, docs.agg(F.count_distinct(tenant)).first()[0])
    sent = F.broadcast if few(asked, tenants) else lambda rows: rows
    idf = F.when(F.col("raw") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("raw"))
    weights = rated.join(sent(asked), [*own, "token"]).join(of_tenant, tenant).select("query_id", tenant, "token", "mean", (F.col("times") * idf * (k1 + 1)).alias("weight"))
    said = said_words(docs, tenant, key, text).join(sent(asked.select(*own, "token").distinct()), [*own, "token"], "left_semi")
    hit = said.groupBy(tenant, key, "token", "len").agg(F.count("*").alias("tf")).join(sent(weights), [tenant, "token"])
    part = F.col("weight") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    scores = hit.groupBy("query_id", tenant, key).agg(F.round(F.sum(part), 6).alias("score"))
    return top_k(scores, ["query_id", tenant], [F.desc("score"), F.col(key)], k).where("score > 0")


def overlap(docs: DataFrame, queries: DataFrame, tenant: str, key: str, text: str, k: int) -> DataFrame:
    """(query_id, tenant, key, score, rank): the k documents of each tenant that have the most distinct tokens of a query (query_id, token)."""
    asked = queries.select("query_id", "token").distinct()
    asked = F.broadcast(asked) if few(asked) else asked
    words = said_words(docs, tenant, key, text).select(tenant, key, "token").join(asked.select("token").distinct(), "token", "left_semi").distinct()
    shared = words.join(asked, "token").groupBy("query_id", tenant, key).agg(F.count("*").alias("score"))
    return top_k(shared, ["query_id", tenant], [F.desc("score"), F.col(key)], k)


def dot(a: Column, b: Column) -> Column:
    pair = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pair, F.lit(0.0), lambda s, x: s + x)


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (length(a) * length(b))


def dense(vectors: DataFrame, queries: DataFrame, tenant: str, key: str, vector: str, k: int, score=dot) -> DataFrame:
    """(query_id, tenant, key, score, rank): each query (query_id, tenant, query) against the vectors of its tenant."""
    if score is cosine:  # lengths are found once for a vector, not for each pair
        queries, vectors = queries.withColumn("_asked_length", length(F.col("query"))), vectors.withColumn("_length", length(F.col(vector)))
        met = queries.join(vectors, tenant)
        found = dot(F.col(vector), F.col("query")) / (F.col("_length") * F.col("_asked_length"))
    else:
        met = queries.join(vectors, tenant)
        found = score(F.col(vector), F.col("query"))
    scores = met.select("query_id", tenant, key, F.round(found, 6).alias("score"))
    return top_k(scores, ["query_id", tenant], [F.desc("score"), F.col(key)], k)


def overlap_score(query: Column, text: Column) -> Column:
    """The share of a query's content words that a text has: the default reranker."""
    words = content_words(query)
    return F.when(F.size(words) == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(words, content_words(text))) / F.size(words), 6))


def rerank(candidates: DataFrame, keys: list[str], item: str, query: str, text: str, k: int, score=overlap_score) -> DataFrame:
    """Candidates scored again and cut to k; the former rank breaks ties."""
    scored = candidates.withColumn("score", score(F.col(query), F.col(text)))
    return top_k(scored.withColumnRenamed("rank", "former"), keys, [F.desc("score"), F.col("former"), F.col(item)], k).drop("former")


def identity_order(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The reranker that keeps the order: scores n to 1."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return candidates.withColumn("score", (n - F.col("rank") + 1).cast("double"))


def definitions(hits: DataFrame, terms: DataFrame, key: str, text: str, most: int = 2, least_length: int = 4) -> DataFrame:
    """(key, term, place): the longest terms whose words a text has.

    Only (key, word) is shuffled to meet the terms' first words; the text is met once for each term that it may have.
    """
    words = hits.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("word"))
    met = words.join(terms.where(F.length("term") >= least_length).select("term", F.element_at(tokens(F.col("term")), 1).alias("word")), "word")
    met = met.groupBy(key).agg(F.collect_set("term").alias("terms"))
    padded = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0)), " "), F.lit(" "))
    said = hits.select(key, text).join(met, key).withColumn("_said", padded)
    used = F.filter("terms", lambda t: F.contains(F.col("_said"), F.concat(F.lit(" "), F.lower(t), F.lit(" "))))
    return top_k(said.select(key, F.explode(used).alias("term")).distinct(), [key], [F.desc(F.length("term")), F.col("term")], most, "place")
