"""Search inside an account: dense and BM25 rankings, fused, reranked, with the definitions of terms that hits use.

An index is a table of chunks (chunks.CHUNKS) with embeddings; questions are (query_id, account, query), so that any
number of them is one job. The account is a join key throughout: no row of another account can be ranked. Defined results:
an account without chunks gives nothing; scores of equal value are ordered by chunk_id; an empty query ranks by dense only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.functions import embed
from clausewise.functions.text import tokens
from clausewise.operators import chunks as C
from clausewise.operators import ranking, relational

HITS = "query_id account chunk_id score rank via".split()


@dataclass(frozen=True)
class Config:
    mode: str = "hybrid"  # dense, bm25 or hybrid
    rerank: bool = False
    k: int = 5
    candidates: int = 30
    definitions: bool = False
    most_definitions: int = 2


#: Embedders (a column function of texts) and rerankers (of query and text) by name; others may be added.
EMBEDDERS: dict[str, Callable[[Column], Column]] = {"hash": embed.hashed}
RERANKERS: dict[str, Callable[[Column, Column], Column] | None] = {"overlap": ranking.overlap_score, "none": None}


def embed_text() -> Column:
    return F.when(F.col("header").isNull() | (F.col("header") == ""), F.col("text")).otherwise(F.concat("header", F.lit("\n"), "text"))


def build_index(chunks: DataFrame, embedder: str = "hash", cache: DataFrame | None = None) -> DataFrame:
    """Chunks with said (what is searched) and embedding; each distinct text is embedded once, or not at all if cached."""
    return embed.embedded(chunks.withColumn("said", embed_text()), "said", cache, EMBEDDERS[embedder])


def as_of_index(accounts: DataFrame, ops: DataFrame, clauses: DataFrame, at: DataFrame, variant: str = "header", embedder: str = "hash") -> DataFrame:
    """The index of the accounts that `at` (account, as_of) names, resolved at their dates."""
    asked = accounts.join(at.select("account"), "account", "left_semi")
    resolved = C.resolve_accounts(asked, ops, clauses, at)
    return build_index(C.build_chunks(asked, variant, clauses, changed=resolved.changed), embedder)


def full_text(index: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, account, chunk_id): chunks that have every word of a question, as a plain AND search."""
    asked = questions.select("query_id", "account", F.explode(F.array_distinct(tokens(F.col("query")))).alias("token"), F.size(F.array_distinct(tokens(F.col("query")))).alias("n"))
    words = index.select("account", "chunk_id", F.explode(F.array_distinct(tokens(F.col("said")))).alias("token"))
    return words.join(asked, ["account", "token"]).groupBy("query_id", "account", "chunk_id", "n").agg(F.count("*").alias("c")).where("c = n").select("query_id", "account", "chunk_id")


def _ranked(index: DataFrame, questions: DataFrame, mode: str, n: int, embedder: str) -> DataFrame:
    if mode == "dense":
        vectors = index.select("account", "chunk_id", "embedding")
        asked = questions.select("query_id", "account", EMBEDDERS[embedder](F.col("query")).alias("query"))
        return ranking.dense(vectors, asked, "account", "chunk_id", "embedding", n).select(*HITS[:5], F.lit("dense").alias("via"))
    asked = questions.select("query_id", "account", F.explode(tokens(F.col("query"))).alias("token"))
    return ranking.bm25(index, asked, "account", "chunk_id", "said", n).select(*HITS[:5], F.lit("bm25").alias("via"))


def search(index: DataFrame, questions: DataFrame, config: Config = Config(), clauses: DataFrame | None = None, embedder: str = "hash", reranker: str = "overlap") -> DataFrame:
    """(HITS) the k best chunks of each question. clauses (path, term), for definitions of the terms that hits use."""
    n = config.candidates if config.rerank else config.k
    modes = [m for m in ("dense", "bm25") if config.mode in (m, "hybrid")]
    lists = [_ranked(index, questions, m, n, embedder) for m in modes]
    hits = lists[0] if len(lists) == 1 else relational.fuse(lists, ["query_id", "account"], "chunk_id", names=modes)
    score = RERANKERS[reranker] if config.rerank else None
    if score is not None:
        met = hits.join(questions.select("query_id", "query"), "query_id").join(index.select("account", "chunk_id", "said"), ["account", "chunk_id"])
        hits = ranking.rerank(met, ["query_id", "account"], "chunk_id", "query", "said", config.k, score).withColumn("via", F.concat("via", F.lit("+rerank")))
    hits = hits.where(F.col("rank") <= config.k).select(*HITS)
    if config.definitions and clauses is not None:
        hits = hits.unionByName(definition_hits(hits, index, clauses, config.most_definitions))
    return hits


def definition_hits(hits: DataFrame, index: DataFrame, clauses: DataFrame, most: int = 2) -> DataFrame:
    """(HITS) the clauses that define terms which a question's hits use, but for those that hits cover already; the longest terms first."""
    text = hits.join(index.select("account", "chunk_id", "text", "paths"), ["account", "chunk_id"])
    said = text.groupBy("query_id", "account").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"), F.flatten(F.collect_list("paths")).alias("have"), F.max("rank").alias("last"))
    terms = clauses.where("term is not null and length(term) >= 4").select("term", "path")
    met = ranking.definitions(said.select(F.struct("query_id", "account").alias("q"), "text"), terms.select("term").distinct(), "q", "text", 1 << 30)
    wanted = met.select("q.query_id", "q.account", "term").join(terms, "term").join(said.select("query_id", "account", "have", "last"), ["query_id", "account"]).where(~F.array_contains("have", F.col("path")))
    wanted = wanted.groupBy("query_id", "account", "path", "last").agg(F.max(F.length("term")).alias("long"), F.min("term").alias("term"))
    wanted = relational.top_k(wanted, ["query_id", "account"], [F.desc("long"), F.col("term")], most, "nth")
    found = wanted.join(index.where("kind = 'clause'").select("account", "chunk_id", "ordinal", F.get("paths", F.lit(0)).alias("path")), ["account", "path"])
    found = relational.top_k(found, ["query_id", "account"], [F.col("ordinal"), F.col("chunk_id")], most, "nth2")
    return found.select("query_id", "account", "chunk_id", F.lit(0.0).alias("score"), (F.col("last") + F.col("nth2")).cast("int").alias("rank"), F.lit("definition").alias("via"))
