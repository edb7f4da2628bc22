"""The standard tables as corpus, questions and vectors of the retrieval operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bm25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: Tables under so many bytes per core, and of fewer files than cores, are dealt out to all cores.
SMALL_BYTES = 16 << 20


def spread(rows: DataFrame) -> DataFrame:
    """A small table, often one row group and so one task, dealt out to all cores.

    Tables that fill the cluster stay as they are, without a shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * SMALL_BYTES and len(rows.inputFiles()) < cores else rows


#: The first sentence or line of a text stands for an article's title.
TITLE = r"^[^.!?\n]*"


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as articles: the source as law, the id as article number, the first sentence as title."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select(
        "doc_id",
        F.format_string("%s_madde_%d", F.col("source"), F.col("doc_id")).alias("id"),
        F.concat(F.lit("Law "), "source").alias("law_name"),
        F.col("source").alias("law_no"),
        F.format_string("Madde %d", "doc_id").alias("article_no"),
        F.regexp_extract("text", TITLE, 0).alias("article_title"),
        "text",
        F.col("lang").alias("source_url"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` items as questions, each with the vector of its number."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return items.join(vectors, "query_id", "left")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every four neighbouring documents share a parent."""
    return table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 4).cast("long").alias("parent_id"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold parents of each question: that of its number and the one after."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return items.withColumn("parent_id", F.explode(F.array(F.floor(F.col("query_id") / 4).cast("long"), (F.floor(F.col("query_id") / 4) + 1).cast("long"))))


_KEPT: dict[tuple[str, str], str] = {}


def lexical_index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    """The BM25 index of the articles, built at first use and kept for the session.

    It lies in the shared folder of ``spark.checkpoint.dir`` and is known by
    names, sizes and times of the files behind it, so new files make a new one.
    """
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    mark = str(files.agg(F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)"))).first()[0])
    known = spark.sparkContext.applicationId, mark
    if known not in _KEPT:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"{folder or tempfile.mkdtemp(prefix='siftgrid-')}/siftgrid-index/{known[0]}/{mark}"
        bm25.write_index(articles(spark, sf_dir), path)
        _KEPT[known] = path
    return bm25.read_index(spark, _KEPT[known])
