"""Blending, reranking, boosting and de-duplicating candidates per query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tokens import title_relevance

ALPHA, DENSE_CANDIDATES, BM25_CANDIDATES, PRELIMINARY = 0.55, 150, 250, 80
#: Law, article and exact-citation boosts by profile.
PROFILES = {"none": (0.0, 0.0, 0.0), "default": (0.05, 0.25, 0.50), "strong": (0.10, 0.40, 0.80)}


def minmax(value: Column, window) -> Column:
    """Scaled to 0..1 within the window; 1 where all values are equal."""
    lo, hi = F.min(value).over(window), F.max(value).over(window)
    return F.when(lo == hi, F.lit(1.0)).otherwise((value - lo) / (hi - lo))


def candidates(dense: DataFrame, bm25: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Union of both candidate lists; a missing score is 0.

    A union and one aggregation instead of a full outer join: one shuffle.
    """
    keys = keys or ["query_id"]
    both = dense.select(*keys, "doc_id", F.col("dense"), F.lit(None).cast("double").alias("bm25")).unionByName(bm25.select(*keys, "doc_id", F.lit(None).cast("double").alias("dense"), F.col("bm25")))
    return both.groupBy(*keys, "doc_id").agg(F.coalesce(F.max("dense"), F.lit(0.0)).alias("dense_raw"), F.coalesce(F.max("bm25"), F.lit(0.0)).alias("bm25_raw"))


def blend(pool: DataFrame, alpha: float | Column = ALPHA, k: int | Column = PRELIMINARY, keys: list[str] | None = None) -> DataFrame:
    """Min-max both scores within a query, blend them, keep the ``k`` best.

    Ties go to the smaller ``doc_id``.  ``alpha`` and ``k`` may be columns, so
    that one pass evaluates many configurations (their key is one of ``keys``).
    """
    keys = keys or ["query_id"]
    whole = W.partitionBy(*keys)
    alpha = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    scaled = pool.withColumn("dense", minmax(F.col("dense_raw"), whole)).withColumn("bm25", minmax(F.col("bm25_raw"), whole))
    scored = scaled.withColumn("score", alpha * F.col("dense") + (1 - alpha) * F.col("bm25"))
    return scored.withColumn("rank", F.row_number().over(whole.orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)


def hybrid_rank(dense: DataFrame, bm25: DataFrame, alpha: float = ALPHA, k: int = PRELIMINARY) -> DataFrame:
    """``query_id, doc_id, dense_raw, bm25_raw, dense, bm25, score, rank``."""
    return blend(candidates(dense, bm25), alpha, k)


def rank_by(frame: DataFrame, score: str = "score", keys: list[str] | None = None, tie: str = "doc_id") -> DataFrame:
    return frame.withColumn("rank", F.row_number().over(W.partitionBy(*(keys or ["query_id"])).orderBy(F.desc(score), tie)))


def rerank(ranked: DataFrame, texts: DataFrame, questions: DataFrame, scorer: Callable[[Column, Column], Column]) -> DataFrame:
    """Score (question, text) pairs by any column function and order by it.

    ``texts(doc_id, text)``, ``questions(query_id, question)``; the former
    score stays as ``preliminary``.  Scored pairs are the candidates only.
    """
    pairs = ranked.withColumnRenamed("score", "preliminary").drop("rank").join(texts.select("doc_id", "text"), "doc_id").join(questions.select("query_id", "question"), "query_id")
    return rank_by(pairs.withColumn("score", scorer(F.col("question"), F.col("text")).cast("double")).drop("text"))


def fuse(reranked: DataFrame, reranker_weight: float = 0.35, hybrid_weight: float = 0.65) -> DataFrame:
    """Scaled rerank score and preliminary score, weighted."""
    scaled = minmax(F.col("score"), W.partitionBy("query_id"))
    return rank_by(reranked.withColumn("score", reranker_weight * scaled + hybrid_weight * F.col("preliminary")))


def fuse_with_title(reranked: DataFrame, titles: DataFrame, reranker_weight: float = 0.55, preliminary_weight: float = 0.10, title_weight: float = 0.35, direct_bonus: float = 0.30, direct_from: float = 0.75) -> DataFrame:
    """As :func:`fuse`, with title relevance and a bonus for direct titles; needs ``question``."""
    scaled = minmax(F.col("score"), W.partitionBy("query_id"))
    named = reranked.withColumn("scaled", scaled).join(titles.select("doc_id", "article_title"), "doc_id", "left").withColumn("title_score", title_relevance(F.col("question"), F.col("article_title")))
    bonus = F.when(F.col("title_score") >= direct_from, direct_bonus).otherwise(0.0)
    total = reranker_weight * F.col("scaled") + preliminary_weight * F.col("preliminary") + title_weight * F.col("title_score") + bonus
    return rank_by(named.withColumn("score", total).drop("scaled", "article_title"))


def boost(ranked: DataFrame, hints: DataFrame, chunk_keys: DataFrame, law: float | Column = 0.05, article: float | Column = 0.25, exact: float | Column = 0.50, keys: list[str] | None = None) -> DataFrame:
    """Raise candidates whose law or article the question names.

    ``hints(query_id, law_hints, article_hints)`` and
    ``chunk_keys(doc_id, law_no, article_keys)``.  An article counts half if the
    law does not match; a question without hints keeps its order.
    """
    named = ranked.join(hints, "query_id", "left").join(chunk_keys, "doc_id", "left")
    law_match = F.coalesce(F.array_contains(F.col("law_hints"), F.col("law_no")), F.lit(False))
    article_match = F.coalesce(F.arrays_overlap("article_hints", "article_keys"), F.lit(False))
    law, article, exact = (x if isinstance(x, Column) else F.lit(float(x)) for x in (law, article, exact))
    bonus = F.when(law_match, law).otherwise(0.0) + F.when(law_match & article_match, article + exact).when(article_match, article * 0.5).otherwise(0.0)
    return rank_by(named.withColumn("score", F.col("score") + bonus).drop("law_hints", "article_hints", "law_no", "article_keys"), keys=keys)


def best_of_parent(ranked: DataFrame, parents: DataFrame | None, k: int, keys: list[str] | None = None) -> DataFrame:
    """The best candidate of each parent, then the first ``k``, ranked anew.

    It runs after candidates were cut, so fewer than ``k`` rows may be left.
    ``parents(doc_id, parent_id)`` unless the rows have a ``parent_id``.
    """
    keys = keys or ["query_id"]
    rows = ranked.join(parents.select("doc_id", "parent_id"), "doc_id") if parents is not None else ranked
    first = rows.withColumn("in_parent", F.row_number().over(W.partitionBy(*keys, "parent_id").orderBy("rank"))).where("in_parent = 1").drop("in_parent")
    return first.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy("rank"))).where(F.col("rank") <= k)
