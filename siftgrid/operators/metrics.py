"""Ranking metrics and answer metrics."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.text import normalize_answer, words


def ideal_dcg(relevant: Column, k: int) -> Column:
    n = F.least(relevant, F.lit(k)).cast("int")
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))).otherwise(0.0)


def details(results: DataFrame, gold: DataFrame, k: int = 10, keys: list[str] | None = None) -> DataFrame:
    """``query_id, hit_rank, ndcg`` per query of ``gold(query_id, parent_id)``.

    ``results(query_id, parent_id, rank)``; queries without hits have a null
    ``hit_rank``.  With ``keys`` beyond ``query_id`` (configurations), they are
    those of ``results``.
    """
    keys = keys or ["query_id"]
    extra = [c for c in keys if c != "query_id"]
    right = gold.select("query_id", "parent_id").distinct()
    hits = results.join(right, ["query_id", "parent_id"], "left_semi")
    found = hits.groupBy(*keys).agg(F.min("rank").alias("hit_rank"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"))
    asked = right.groupBy("query_id").agg(F.count("*").alias("relevant"))
    if extra:
        asked = asked.crossJoin(F.broadcast(results.select(*extra).distinct()))
    ideal = ideal_dcg(F.col("relevant"), k)
    return asked.join(found, keys, "left").select(*keys, "hit_rank", F.when(ideal > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg"))


def summarize(per_query: DataFrame, ks: tuple[int, ...] = (5, 10), keys: list[str] | None = None) -> DataFrame:
    """``queries, recall_at_k (share of queries with a hit by k), top1, mrr, ndcg_at_10``; zeros without queries."""
    total = F.greatest(F.count("*"), F.lit(1))
    share = lambda condition: F.coalesce(F.sum(F.when(condition, 1.0).otherwise(0.0)) / total, F.lit(0.0))
    return per_query.groupBy(*(keys or [])).agg(
        F.count("*").alias("queries"),
        *[share(F.col("hit_rank") <= k).alias(f"recall_at_{k}") for k in ks],
        share(F.col("hit_rank") == 1).alias("top1_accuracy"),
        F.coalesce(F.sum(F.coalesce(1.0 / F.col("hit_rank"), F.lit(0.0))) / total, F.lit(0.0)).alias("mrr"),
        F.coalesce(F.sum("ndcg") / total, F.lit(0.0)).alias("ndcg_at_10"),
    )


def selection_score() -> Column:
    return 0.45 * F.col("recall_at_5") + 0.25 * F.col("recall_at_10") + 0.20 * F.col("mrr") + 0.10 * F.col("ndcg_at_10")


def exact_match(prediction: Column, reference: Column) -> Column:
    """1 if both are the same words, else 0; a missing text equals none."""
    return F.coalesce(normalize_answer(prediction) == normalize_answer(reference), F.lit(False)).cast("double")


def _empty_case(p: Column, r: Column, other: Column) -> Column:
    return F.when((F.size(p) == 0) | (F.size(r) == 0), (F.size(p) == F.size(r)).cast("double")).otherwise(other)


def _f1(shared: Column, p: Column, r: Column) -> Column:
    precision, recall = shared / F.size(p), shared / F.size(r)
    return F.when(shared > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def token_f1(prediction: Column, reference: Column) -> Column:
    """F1 of the words as multisets; 1 if both are empty, 0 if one is.

    Equal words are counted by an Arrow UDF, in time linear in the lists.
    """
    p, r = words(F.lower(prediction)), words(F.lower(reference))
    return _empty_case(p, r, _f1(common_words(p, r), p, r))


def common_words(p: Column, r: Column) -> Column:
    """Size of the intersection of two lists as multisets; 0 if either is null."""

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([0 if a is None or b is None else (Counter(a) & Counter(b)).total() for a, b in zip(left, right)], dtype="int64")

    return pandas_udf(run, "long")(p, r)


def subsequence_length(p, r) -> int:
    """Longest common subsequence of two lists, a row of the table as the bits of one integer."""
    places: dict = {}
    for i, word in enumerate(r):
        places[word] = places.get(word, 0) | 1 << i
    full = row = (1 << len(r)) - 1
    for word in p:
        same = row & places.get(word, 0)
        row = (row + same | row - same) & full
    return len(r) - row.bit_count()


def common_subsequence(p: Column, r: Column) -> Column:
    """Length of the longest common subsequence, by an Arrow UDF; memory is linear in the lists."""

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([0 if a is None or b is None else subsequence_length(a, b) for a, b in zip(left, right)], dtype="int64")

    return pandas_udf(run, "long")(p, r)


def rouge_l(prediction: Column, reference: Column) -> Column:
    p, r = words(F.lower(prediction)), words(F.lower(reference))
    # element_at() of an empty array is avoided by the case for empty sides.
    return F.when((F.size(p) == 0) | (F.size(r) == 0), (F.size(p) == F.size(r)).cast("double")).otherwise(_f1(common_subsequence(p, r), p, r))


def answer_metrics(rows: DataFrame, prediction: str = "generated_answer", reference: str = "expected_answer") -> DataFrame:
    """``em, f1, rouge_l`` beside the rows; null where there is no reference."""
    p, r = F.coalesce(F.col(prediction), F.lit("")), F.coalesce(F.col(reference), F.lit(""))
    known = F.trim(r) != ""
    return rows.withColumns({"em": F.when(known, exact_match(p, r)), "f1": F.when(known, token_f1(p, r)), "rouge_l": F.when(known, rouge_l(p, r))})


def retrieval_metrics(rows: DataFrame, contexts: str = "retrieved_ids", gold: str = "gold_document_ids") -> DataFrame:
    """``retrieval_hit, reciprocal_rank`` from ordered ids; null where there is no gold."""
    places = F.transform(F.col(contexts), lambda x, i: F.when(F.array_contains(F.col(gold), x), i + 1))
    rank = F.array_min(F.filter(places, lambda x: x.isNotNull()))
    known = F.size(gold) > 0
    return rows.withColumns({"retrieval_hit": F.when(known, F.when(rank.isNotNull(), 1.0).otherwise(0.0)), "reciprocal_rank": F.when(known, F.coalesce(1.0 / rank, F.lit(0.0)))})


def model_summary(rows: DataFrame) -> DataFrame:
    """Per model: questions and the averages of known metrics."""
    return rows.groupBy("model").agg(F.count("*").alias("questions"), F.avg("em").alias("em"), F.avg("f1").alias("f1"), F.avg("rouge_l").alias("rouge_l"), F.avg("retrieval_hit").alias("retrieval_hit"), F.avg("reciprocal_rank").alias("mrr"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
