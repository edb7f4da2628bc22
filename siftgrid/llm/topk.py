"""Exact top-k inner-product search with two cover trees (operator 4).

Vectors are dealt into blocks.  Each block builds a cover tree - every node has
a centre, a covering radius and children whose radii shrink by ``SHRINK`` - and
so does each block of queries.  Both trees are walked together: for a pair of
nodes the inner product of any query and any vector below them is at most

    <q, p> + |p| r_q + |q| r_p + r_q r_p

and the pair is dropped if that is less than the worst k-th best score within
the query node (equal bounds are followed, since ties go to smaller ids).
Children are visited best bound first.  The k best of every block are merged
per query by a window, so each query gets k rows per block at most.

Components become integers by floor(scale * x); sums of products of integers
below 2**53 are exact in doubles, so that scores are exact.  An inner product needs
two vectors of one length, so the candidates of a query are the vectors of its
own length; each length has its own blocks and trees.

Defined results: vectors that are null or hold null or non-finite components
take no part; a row is not its own candidate, told by its id - rows that share
an id are one candidate if their vectors are equal, else several; equal
vectors at equal scores are told apart by id; fewer candidates than k give
fewer rows; empty vectors take part among themselves, with score 0; an empty
table gives no rows; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean_group

BLOCK_ROWS = 8_192
QUERY_BLOCK_ROWS = 512
#: Query blocks that meet a block of candidates in one task.
QUERY_BLOCKS_TOGETHER = 64
LEAF = 64
SHRINK = 0.6
#: Slack of bounds against rounding, relative to their terms.
SLACK = 1e-9


@dataclass
class Node:
    centre: np.ndarray
    norm: float
    radius: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)


def cover_tree(points: np.ndarray, rows: np.ndarray | None = None, radius: float | None = None) -> Node:
    """A cover tree over ``points[rows]``; leaves hold up to ``LEAF`` rows or equal points."""
    rows = np.arange(len(points)) if rows is None else rows
    own = points[rows]
    centre = own[0]
    far = np.sqrt(np.maximum(((own - centre) ** 2).sum(axis=1), 0))
    node = Node(centre, float(np.sqrt(centre @ centre)), float(far.max()), rows)
    if len(rows) <= LEAF or node.radius == 0:
        return node
    reach = min(node.radius, radius if radius is not None else node.radius) * SHRINK
    while True:
        # Greedy cover: centres are further than ``reach`` from each other.
        owner = np.full(len(rows), -1)
        nearest = np.full(len(rows), np.inf)
        order, k = 0, 0
        while True:
            distance = np.sqrt(((own - own[order]) ** 2).sum(axis=1))
            closer = distance < nearest
            nearest[closer], owner[closer] = distance[closer], k
            k += 1
            order = int(nearest.argmax())
            if nearest[order] <= reach or k >= max(8, len(rows) // LEAF):
                break
        if k > 1:
            break
        reach *= SHRINK
    node.children = [cover_tree(points, rows[owner == c], reach) for c in range(k)]
    return node


class Best:
    """The k best candidates of each query: score down, then id up."""

    def __init__(self, ids: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.worst = np.full(len(ids), -np.inf)

    def offer(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        for i, q in enumerate(queries.tolist()):
            row = scores[i]
            good = np.flatnonzero((row >= self.worst[q]) & (ids != self.ids[q]))
            if not len(good):
                continue
            if len(good) > self.k:
                # Ties at the k-th score stay: their ids decide.
                kth = np.partition(row[good], len(good) - self.k)[len(good) - self.k]
                good = good[row[good] >= kth]
            new = [(-int(row[j]), int(ids[j])) for j in good.tolist()]
            self.found[q] = heapq.nsmallest(self.k, self.found[q] + new)
            if len(self.found[q]) == self.k:
                self.worst[q] = -self.found[q][-1][0]


def dual_search(queries: np.ndarray, query_tree: Node, points: np.ndarray, ids: np.ndarray, tree: Node, best: Best) -> int:
    """Walk both trees; returns the number of node pairs whose rows were compared."""
    compared = 0

    def bound(q: Node, p: Node) -> float:
        a, b, c, d = float(q.centre @ p.centre), p.norm * q.radius, q.norm * p.radius, q.radius * p.radius
        return a + b + c + d + SLACK * (abs(a) + b + c + d + 1)

    heap = [(-bound(query_tree, tree), 0, query_tree, tree)]
    tie = 1
    while heap:
        top, _, q, p = heapq.heappop(heap)
        if -top < best.worst[q.rows].min():
            continue
        if not q.children and not p.children:
            best.offer(q.rows, queries[q.rows] @ points[p.rows].T, ids[p.rows])
            compared += 1
            continue
        if q.children and (not p.children or q.radius >= p.radius):
            pairs = [(c, p) for c in q.children]
        else:
            pairs = [(q, c) for c in p.children]
        for a, b in pairs:
            most = bound(a, b)
            if most >= best.worst[a.rows].min():
                heapq.heappush(heap, (-most, tie, a, b))
                tie += 1
    return compared


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), dimension).astype(np.float64)


def integer_vectors(frame: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of every usable vector."""
    ok = F.col(vector).isNotNull() & F.col(key).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return frame.where(ok).select(F.col(key).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def search(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows where ``is_query`` holds."""
    usable = integer_vectors(vectors, key, vector, scale).withColumn("n", F.size("v"))
    asked = integer_vectors(vectors.where(is_query), key, vector, scale).withColumn("n", F.size("v"))
    # The length with most vectors decides how many blocks each length has.
    n_blocks = max(2, -(-(usable.groupBy("n").count().agg(F.max("count")).first()[0] or 0) // BLOCK_ROWS))
    n_query_blocks = max(1, -(-asked.count() // QUERY_BLOCK_ROWS))

    # Blocks of candidates and of queries meet as (query block, block) pairs.
    deal = F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)).cast("int")
    n_shares = -(-n_query_blocks // QUERY_BLOCKS_TOGETHER)
    shares = F.explode(F.sequence(F.lit(0), F.lit(n_shares - 1))) if n_shares > 1 else F.lit(0)
    data = usable.select("n", deal.alias("block"), shares.alias("share"), F.lit(False).alias("asks"), F.lit(-1).alias("part"), "vec_id", "v")
    part = F.pmod(F.xxhash64("vec_id"), F.lit(n_query_blocks)).cast("int")
    asks = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).select("n", "block", F.pmod(part, F.lit(n_shares)).alias("share"), F.lit(True).alias("asks"), part.alias("part"), "vec_id", "v")

    def pair(table: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        asks = table.column("asks").to_numpy()
        dimension = table.column("n")[0].as_py()
        own = table.filter(pa.array(~asks)).combine_chunks()
        ids, points = own.column("vec_id").to_numpy(), _matrix(own.column("v").combine_chunks() if own.num_rows else pa.array([], pa.list_(pa.float64())), dimension)
        queries = table.filter(pa.array(asks)).combine_chunks()
        if len(ids) and queries.num_rows:
            if len(np.unique(ids)) < len(ids):
                once = list({(int(i), v.tobytes()): n for n, (i, v) in enumerate(zip(ids, points))}.values())
                ids, points = ids[once], points[once]
            tree = cover_tree(points)
            parts = queries.column("part").to_numpy()
            for p in np.unique(parts).tolist():
                group = queries.filter(pa.array(parts == p)).combine_chunks()
                q_ids, q_points = group.column("vec_id").to_numpy(), _matrix(group.column("v").combine_chunks(), dimension)
                best = Best(q_ids, k)
                dual_search(q_points, cover_tree(q_points), points, ids, tree, best)
                out += [(int(q), i, -s) for q, found in zip(q_ids, best.found) for s, i in found]
        columns = list(zip(*out)) if out else [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    found = data.unionByName(asks).groupBy("n", "block", "share").applyInArrow(lean_group(pair), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
