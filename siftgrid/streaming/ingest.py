"""Incremental ingestion: a folder of documents to chunks and postings.

This is an extension: batches of new files are cut into chunks and their
postings are appended, so that a lexical index can be searched while it grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import index_terms
from ..operators.bm25 import Index
from ..operators.chunking import sliding_chunks

DOCUMENT = "id string, law_name string, law_no string, article_no string, article_title string, text string, source_url string"


def document_stream(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """New JSON-lines files of a folder, as a stream of documents."""
    return spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", per_batch).json(folder)


def append_chunks(target: str, max_words: int = 450, overlap: int = 64):
    """A ``foreachBatch`` function; a batch that is run again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        chunks = sliding_chunks(batch, max_words, overlap)
        chunks.write.mode("overwrite").parquet(f"{target}/chunks/batch={number}")
        terms = batch.sparkSession.read.parquet(f"{target}/chunks/batch={number}").select(F.col("id").alias("doc_id"), index_terms(F.col("text")).alias("terms"))
        terms.select("doc_id", F.size("terms").cast("long").alias("dl")).write.mode("overwrite").parquet(f"{target}/lengths/batch={number}")
        terms.select("doc_id", F.explode("terms").alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf")).write.mode("overwrite").parquet(f"{target}/postings/batch={number}")

    return write


def start(stream: DataFrame, target: str, checkpoint: str, once: bool = True):
    writer = stream.writeStream.foreachBatch(append_chunks(target)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stored_index(spark: SparkSession, target: str) -> Index:
    """The index of everything appended so far."""
    postings = spark.read.parquet(f"{target}/postings").drop("batch")
    lengths = spark.read.parquet(f"{target}/lengths").drop("batch")
    frequencies = postings.groupBy("term").agg(F.count("*").alias("df"))
    totals = lengths.agg(F.count("*").alias("n"), (F.sum("dl") / F.greatest(F.count("*"), F.lit(1))).alias("avgdl"))
    return Index(postings, frequencies, lengths, totals)
