"""Labelled pairs composed from search, positives and negatives, with their counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.legal import article_sort_key, question_article
from ..operators import bm25 as lexical
from ..operators import pairs


def _first_by_rank(rows: DataFrame, k: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where(F.col("_n") <= k).drop("_n")


def clean_pairs(questions: DataFrame, chunks: DataFrame, found: DataFrame, positives: int = 2, negatives: int = 5, pool: int = 80) -> DataFrame:
    """``query_id, doc_id, label, bm25``: first chunks of each question's parent, and best candidates of other parents.

    ``questions(query_id, positive_parent_id)``, ``chunks(doc_id, id, parent_id,
    chunk_index)``, ``found(query_id, doc_id, bm25, rank)``.  Questions whose
    parent has no chunk give no rows; a null parent has none.
    """
    asked = questions.select("query_id", "positive_parent_id")
    good = pairs.positive_chunks(asked, chunks, positives).select("query_id", "doc_id", F.lit(1).alias("label"), F.lit(None).cast("double").alias("bm25"))
    known = asked.join(chunks.select(F.col("parent_id").alias("positive_parent_id")).distinct(), "positive_parent_id", "left_semi")
    others = found.where(F.col("rank") <= pool).join(chunks.select("doc_id", "parent_id"), "doc_id").join(known, "query_id").where("parent_id <> positive_parent_id")
    return good.unionByName(_first_by_rank(others, negatives).select("query_id", "doc_id", F.lit(0).alias("label"), "bm25"))


def pair_counters(questions: DataFrame, rows: DataFrame, negatives: int = 5) -> DataFrame:
    """One row: questions, how many have pairs, how many too few negatives, and rows by label."""
    per = rows.groupBy("query_id").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad"))
    all_ = questions.select("query_id").distinct().join(per, "query_id", "left")
    used = F.coalesce(F.col("good") > 0, F.lit(False))
    number = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return all_.agg(F.count("*").alias("input_questions"), F.count_if(~used).alias("skipped_no_positive"), F.count_if(used).alias("queries_used"), F.count_if(used & (F.col("bad") < negatives)).alias("queries_with_few_negatives"), number("good").alias("positive_rows"), number("bad").alias("negative_rows"))


def answer_pairs(examples: DataFrame, index: lexical.Index, least_score: float = 5.0, negatives: int = 3, pool: int = 80, seed: int = pairs.SEED) -> DataFrame:
    """``query_id, doc_id, label, score, kind`` of question-answer examples.

    ``examples(query_id, question, answer, context)``.  The best document for
    context, answer and question together is the positive if it scores
    ``least_score``; other examples give no rows.  Negatives are the best other
    documents for the question alone, topped up in random order.
    """
    whole = examples.select("query_id", pairs.positive_query(F.col("context"), F.col("answer"), F.col("question")).alias("question"))
    best = lexical.search(index, whole, 1).where(F.col("bm25") >= least_score).select("query_id", F.col("doc_id").alias("positive_id"), F.col("bm25").alias("score"))
    asked = examples.join(best, "query_id", "left_semi").select("query_id", "question")
    near = lexical.search(index, asked, pool).join(best.select("query_id", "positive_id"), "query_id").where("doc_id <> positive_id")
    hard = _first_by_rank(near, negatives)
    every = index.lengths.select("doc_id", F.col("doc_id").alias("parent_id"))
    more = pairs.top_up_negatives(hard, best.select("query_id", F.col("positive_id").alias("positive_parent_id")), every, negatives, seed)
    good = best.select("query_id", F.col("positive_id").alias("doc_id"), F.lit(1).alias("label"), "score", F.lit("positive").alias("kind"))
    bad = hard.select("query_id", "doc_id", F.lit(0).alias("label"), F.col("bm25").alias("score"), F.lit("bm25").alias("kind"))
    return good.unionByName(bad).unionByName(more.select("query_id", "doc_id", F.lit(0).alias("label"), F.lit(None).cast("double").alias("score"), F.lit("random").alias("kind")))


def explicit_articles(questions: DataFrame, articles: DataFrame) -> DataFrame:
    """``query_id, article_id`` of questions that name an article of a known law.

    ``questions(query_id, question, law_no)``, ``articles(position, id, law_no,
    article_no)``.  Articles are known with and without the slash; of several
    with one number the last by position counts.
    """
    key = article_sort_key(F.coalesce("article_no", F.lit("")))
    keys = F.array_distinct(F.array(key, F.replace(key, F.lit("/"), F.lit(""))))
    known = articles.select("law_no", "position", "id", F.explode(keys).alias("key")).where("key <> ''").groupBy("law_no", "key").agg(F.max_by("id", F.struct("position", "id")).alias("article_id"))
    asked = questions.select("query_id", "law_no", question_article(F.col("question")).alias("key"))
    return asked.join(known, ["law_no", "key"]).select("query_id", "article_id")
