"""Retrieval evaluation, grid search, online retrieval and answer benchmarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.legal import citation
from ..operators import bm25 as lexical
from ..operators import dense as semantic
from ..operators import hybrid, metrics

GRID = {"alpha": (0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70), "dense_candidates": (80, 150, 300), "bm25_candidates": (100, 250, 500), "preliminary": (50, 80, 120), "profile": ("none", "default", "strong")}


def ranked(questions: DataFrame, chunks: DataFrame, index: lexical.Index, mode: str = "hybrid", alpha: float = hybrid.ALPHA, dense_candidates: int = hybrid.DENSE_CANDIDATES, bm25_candidates: int = hybrid.BM25_CANDIDATES, preliminary: int = hybrid.PRELIMINARY, k: int = 10, scorer: Callable[[Column, Column], Column] | None = None, hints: DataFrame | None = None, chunk_keys: DataFrame | None = None, profile: str = "none") -> DataFrame:
    """The ``k`` best parents per question in one of the modes dense, hybrid, rerank or rerank_fusion.

    ``questions(query_id, question, embedding)``, ``chunks(doc_id, parent_id,
    text, embedding)``.
    """
    near = semantic.search(chunks, questions, max(dense_candidates, k))
    if mode == "dense":
        best = near.withColumnRenamed("dense", "score")
    else:
        words = lexical.search(index, questions, bm25_candidates)
        best = hybrid.hybrid_rank(near.where(F.col("rank") <= dense_candidates), words, alpha, preliminary)
        if mode in ("rerank", "rerank_fusion"):
            best = hybrid.rerank(best, chunks, questions, scorer)
            best = hybrid.fuse(best) if mode == "rerank_fusion" else best
    if profile != "none" and hints is not None:
        best = hybrid.boost(best, hints, chunk_keys, *hybrid.PROFILES[profile])
    return hybrid.best_of_parent(best, chunks, k)


def evaluate(results: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (5, 10)) -> tuple[DataFrame, DataFrame]:
    """Details per question and the summary row."""
    per_query = metrics.details(results, gold)
    return per_query, metrics.summarize(per_query, ks)


def grid_table(spark, grid: dict[str, tuple] | None = None) -> DataFrame:
    """One row per combination, with its boosts."""
    grid = {**GRID, **(grid or {})}
    rows, number = [], 0
    for profile in grid["profile"]:
        if profile not in hybrid.PROFILES:
            raise ValueError(f"unknown profile {profile}; known: {sorted(hybrid.PROFILES)}")
        for preliminary in grid["preliminary"]:
            for dense in grid["dense_candidates"]:
                for words in grid["bm25_candidates"]:
                    for alpha in grid["alpha"]:
                        rows.append((number, float(alpha), int(dense), int(words), int(preliminary), profile, *hybrid.PROFILES[profile]))
                        number += 1
    return spark.createDataFrame(rows, "config int, alpha double, dense_candidates int, bm25_candidates int, preliminary int, profile string, law_boost double, article_boost double, exact_boost double")


def grid_search(near: DataFrame, words: DataFrame, parents: DataFrame, gold: DataFrame, grid: DataFrame, hints: DataFrame | None = None, chunk_keys: DataFrame | None = None, k: int = 10) -> DataFrame:
    """Every combination in one plan, best first.

    ``near(query_id, doc_id, dense, rank)`` and ``words(query_id, doc_id, bm25,
    rank)`` are scored once at the greatest candidate counts; a combination
    takes those with a rank within its own.
    """
    keys = ["config", "query_id"]
    few = F.broadcast(grid)
    dense = near.join(few, F.col("rank") <= F.col("dense_candidates")).select("config", "query_id", "doc_id", "dense")
    text = words.join(few, F.col("rank") <= F.col("bm25_candidates")).select("config", "query_id", "doc_id", "bm25")
    pool = hybrid.candidates(dense, text, keys).join(few, "config")
    best = hybrid.blend(pool, F.col("alpha"), F.col("preliminary"), keys)
    if hints is not None:
        best = hybrid.boost(best, hints, chunk_keys, F.col("law_boost"), F.col("article_boost"), F.col("exact_boost"), keys)
    results = hybrid.best_of_parent(best, parents, k, keys)
    summary = metrics.summarize(metrics.details(results, gold, 10, keys), (5, 10), ["config"])
    out = summary.withColumn("selection_score", metrics.selection_score()).join(few, "config")
    order = [F.desc(c) for c in ("selection_score", "recall_at_5", "recall_at_10", "ndcg_at_10", "mrr", "top1_accuracy")]
    return out.withColumn("rank", F.row_number().over(W.orderBy(*order, "config"))).select("rank", "selection_score", "recall_at_5", "recall_at_10", "top1_accuracy", "mrr", "ndcg_at_10", "alpha", "dense_candidates", "bm25_candidates", "preliminary", "profile", "config")


def contexts(results: DataFrame, chunks: DataFrame, articles: DataFrame) -> DataFrame:
    """Result rows with the whole article (or the chunk, if it is unknown), its citation and address."""
    fields = ("law_name", "law_no", "article_no", "article_title", "text", "source_url")
    parents = articles.select(F.col("id").alias("parent_id"), *[F.col(c).alias(f"a_{c}") for c in fields])
    own = chunks.select("doc_id", F.col("id").alias("chunk_id"), *[F.col(c).alias(f"c_{c}") for c in fields])
    rows = results.join(own, "doc_id").join(parents, "parent_id", "left")
    known = F.col("a_text").isNotNull()
    pick = {c: F.when(known, F.col(f"a_{c}")).otherwise(F.col(f"c_{c}")) for c in fields}
    return rows.select("query_id", "rank", "score", *[c for c in ("dense", "bm25") if c in results.columns], "chunk_id", "parent_id", citation(*[pick[c] for c in fields[:4]]).alias("citation"), pick["text"].alias("text"), pick["source_url"].alias("source_url"))


# Labels and instructions of the prompt.
SYSTEM_PROMPT = "Sen bir Türk hukuku RAG asistanısın. Yalnızca verilen kaynak metinlere dayanarak cevap ver. Kaynakta olmayan bilgiyi üretme. Cevabın sonunda kullandığın kanun ve madde citation bilgisini belirt. Kaynaklarda cevap yoksa 'Verilen kaynaklarda bu sorunun cevabı yoktur.' de."


def prompts(context_rows: DataFrame, questions: DataFrame, chars: int = 1800) -> DataFrame:
    """``query_id, messages``: a system and a user message with numbered sources."""
    text = F.left(F.replace(F.trim("text"), F.lit("\n\n\n"), F.lit("\n\n")), F.lit(chars))
    block = F.concat_ws("\n", F.format_string("[Kaynak %d]", "rank"), F.concat(F.lit("Citation: "), "citation"), F.concat(F.lit("Doc ID: "), "parent_id"), F.concat(F.lit("Metin: "), text))
    joined = context_rows.withColumn("block", block).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda s: s["block"]), "\n\n").alias("sources"))
    user = F.concat(F.lit("[Kaynaklar]\n"), F.coalesce("sources", F.lit("")), F.lit("\n\n[Soru]\n"), "question")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return questions.select("query_id", "question").join(joined, "query_id", "left").select("query_id", F.array(message("system", F.lit(SYSTEM_PROMPT)), message("user", user)).alias("messages"))


def answers(prompt_rows: DataFrame, generators: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``query_id, model, generated_answer``: each model answers from the same prompt.

    A generator is any column function of the message list, a pandas UDF that
    serves a model for instance.
    """
    made = F.array(*[F.struct(F.lit(n).alias("model"), g(F.col("messages")).alias("generated_answer")) for n, g in sorted(generators.items())])
    return prompt_rows.select("query_id", F.explode(made).alias("m")).select("query_id", "m.*")


def benchmark(answer_rows: DataFrame, questions: DataFrame, context_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with retrieval and answer metrics, and their averages per model.

    ``questions(query_id, question, expected_answer, gold_document_ids)``.
    """
    ids = context_rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "parent_id"))), lambda s: s["parent_id"]).alias("retrieved_ids"))
    rows = answer_rows.join(questions, "query_id").join(ids, "query_id", "left").withColumn("retrieved_ids", F.coalesce("retrieved_ids", F.array().cast("array<string>")))
    rows = metrics.answer_metrics(metrics.retrieval_metrics(rows))
    return rows, metrics.model_summary(rows)
