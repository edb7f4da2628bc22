"""Exact inner-product search and encoder plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Query rows that every task holds at once; more are dealt into blocks.
QUERY_BLOCK = 4_096
#: Digits to which scores are rounded before they rank, so that equal vectors
#: tie in whatever order their products were summed.
DIGITS = 9


def inner_product(left: Column, right: Column) -> Column:
    """Sum of products, in doubles; vectors of different lengths give null."""
    return F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(vector: Column) -> Column:
    """Unit length; zero vectors stay."""
    size = F.sqrt(inner_product(vector, vector))
    return F.transform(vector, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")))


def search(vectors: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", vector: str = "embedding", query_key: str = "query_id", query_vector: str = "embedding") -> DataFrame:
    """``query_id, doc_id, dense, rank`` for the k greatest inner products.

    Queries are dealt into blocks of ``QUERY_BLOCK`` rows; each block is joined
    with the vectors batch by batch as one matrix product, of which k rows per
    query leave a task.  Ties go to the smaller ``doc_id``.  Null vectors and
    vectors of another length than a query's are not candidates for it.
    """
    asked = queries.select(F.col(query_key).alias("query_id"), F.col(query_vector).cast("array<double>").alias("q")).where("q is not null and query_id is not null")
    rows = vectors.select(F.col(key).cast("long").alias("doc_id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null and doc_id is not null")
    kind = dict(asked.dtypes)["query_id"]
    total = asked.count()
    found = None
    for block in range(max(1, -(-total // QUERY_BLOCK))):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-total // QUERY_BLOCK)))) == block)
        held = vectors.sparkSession.sparkContext.broadcast([(r["query_id"], r["q"]) for r in part.toLocalIterator()])
        one = rows.mapInArrow(_scorer(held, k), f"query_id {kind}, doc_id long, dense double")
        found = one if found is None else found.unionByName(one)
    order = W.partitionBy("query_id").orderBy(F.desc("dense"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scorer(held, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size: dict[int, tuple[list, np.ndarray]] = {}
        for size in {len(q) for _, q in held.value}:
            own = [(i, q) for i, q in held.value if len(q) == size]
            by_size[size] = [i for i, _ in own], np.array([q for _, q in own], dtype=np.float64)
        best: dict = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
            for size, (names, matrix) in by_size.items():
                rows = np.flatnonzero(sizes == size)
                if not len(rows):
                    continue
                points = flat[starts[rows][:, None] + np.arange(size)[None, :]] if size else np.zeros((len(rows), 0))
                scores = np.round(matrix @ points.T, DIGITS)
                for name, row in zip(names, scores):
                    old = best.get(name)
                    s, d = (row, ids[rows]) if old is None else (np.concatenate([old[0], row]), np.concatenate([old[1], ids[rows]]))
                    keep = np.lexsort([d, -s])[:k]
                    best[name] = s[keep], d[keep]
        names = [n for n, (s, _) in best.items() for _ in s]
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate([d for _, d in best.values()])), pa.array(np.concatenate([s for s, _ in best.values()]))], ["query_id", "doc_id", "dense"])

    return run


def query_text(question: Column, prefix: str = "query: ", prompt: str | None = None) -> Column:
    """What an encoder reads: a prompt if there is one, else the prefix, before the question."""
    return F.concat(F.lit(prompt if prompt else prefix), question)


def passage_text(text: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), text)


def hashed_encoder(size: int = 64) -> Callable[[Column], Column]:
    """A deterministic stand-in for an embedding model: signed hashed words, unit length."""

    def encode(text: Column) -> Column:
        tokens = F.split(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+")
        hashes = F.transform(tokens, lambda t: F.xxhash64(t))
        cells = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.filter(hashes, lambda h: F.pmod(h, F.lit(size)) == i), F.lit(0.0), lambda s, h: s + F.when(F.pmod(F.shiftright(h, 8), F.lit(2)) == 0, 1.0).otherwise(-1.0)))
        return normalized(cells)

    return encode


def encode_passages(chunks: DataFrame, encoder: Callable[[Column], Column], text: str = "text", prefix: str = "") -> DataFrame:
    """``chunks`` with an ``embedding`` column from any column function (a pandas UDF, say)."""
    return chunks.withColumn("embedding", encoder(passage_text(F.col(text), prefix)))
