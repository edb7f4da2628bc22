"""The thin ``opN_<name>`` queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, neardup, pii, quality, substrings, token_counts, topk, toxicity
from .common import table


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.match_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written out as raw transcripts, parsed again and rendered."""
    talks = table(spark, sf_dir, "conversations")
    turns = chat.rendered(chat.parse(chat.as_transcripts(talks), chat.fit(talks)))
    return turns.select("conv_id", "block", "turn", "role", "continued", F.length("text").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), digests=("ids", "decoded"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"), digest=True)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), toxicity.held_out_fold()
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold)
    return toxicity.score_documents(docs, model).select("doc_id", fold.alias("held_out"), "score", "predicted")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_token_counts": op2_token_counts,
    "op3_decontaminate": op3_decontaminate,
    "op4_topk": op4_topk,
    "op5_chat": op5_chat,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_pii": op7_pii,
    "op8_substrings": op8_substrings,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
}

ORACLE_SQL: dict[str, str] = {
    "op3_decontaminate": decontaminate.ORACLE,
    "op4_topk": topk.ORACLE,
}
