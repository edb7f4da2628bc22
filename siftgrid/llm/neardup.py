"""Near-duplicate classes by consistent weighted sampling (operator 1).

A text is its multiset of ``SHINGLE``-word shingles, weighted by TF-IDF:
occurrences times ``1 + min(1, ln((N+1)/(df+1)) / ln(1/share))``, an inverse
document frequency that runs from 1 (in every text) to 2 (in ``share`` of the
texts or fewer).  It depends on the share of documents only, so it looks alike
at every size of the corpus.  Frequencies are exact: shingles are first counted
in ``CELLS`` hash cells, and those of cells that reach ``share`` are then counted
one by one.  With S distinct shingles per document on average at most
S / ``share`` shingles are that common, and ``share`` is never under
S / ``COMMON``, so the table that is broadcast has ``COMMON`` rows at most.

1. Improved consistent weighted sampling draws ``BANDS * ROWS`` samples per
   text; two texts agree in one with a probability equal to their weighted
   Jaccard similarity.  ``ROWS`` samples make a band.  ``BY_WEIGHT`` bands
   are drawn by these weights and ``BY_COUNT`` by occurrences alone, as either
   similarity makes a link.  Weights lie between 1 and 2, so a pair with 0.8 by
   one has 2/3 at least by the other; it shares no band with probability 6e-5
   at most, and none is lost later.
2. Equal texts are one node.  In every band bucket each node is compared with
   the least one (so candidates grow linearly): first with the least of all its
   buckets, then with those that are still in another component.  A pair is
   linked if its weighted Jaccard similarity, computed from whole texts, is
   ``SIMILARITY`` or more - with the weights above, or with occurrences alone,
   so that the many copies of one text, whose common shingles weigh little, are
   not lost.  Very popular least nodes are spread over several groups.
3. Buckets whose nodes still lie in different components are compared across
   components, in blocks of about ``BLOCK_NODES`` nodes.  A component with more
   nodes in a bucket has blocks of its own, which never meet each other.
4. Components by alternating large-star and small-star steps until nothing
   changes; the class id is the least document id.

Defined results: texts without words (null ones too) form classes by equal
text; rows of a null id have a null class; rows that share an id are one node,
so their texts' classes are joined; repeated rows are equal texts; an empty
table gives an empty table; very long texts are shingled whole, a row at a
time; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, blocks, checkpoint, id_and_text, lean, lean_group, mix64, prefix_hash, span_hash, text_buffers, word_spans

SHINGLE = 5
SIMILARITY = 0.8
#: Bands drawn by weight and by occurrences.  A pair of similarity 0.8 by one of them has at least
#: 0.8 / (0.8 + 2 * 0.2) = 2/3 by the other; (1 - 0.8**4)**13 * (1 - (2/3)**4)**13 = 6e-5 of such pairs share no band.
BY_WEIGHT, BY_COUNT, ROWS = 13, 13, 4
BANDS = BY_WEIGHT + BY_COUNT
CELL_BITS = 20
CELLS = 1 << CELL_BITS
CELL_CHUNK = 1 << 16
#: A shingle is common from this share of the documents on; and the most shingles that may be common.
SHARE, COMMON = 1 / 1000, 500_000
#: Members per group of a popular node, and nodes of a block in the pairwise step.
MEMBERS, BLOCK_NODES = 256, 256
#: Shared shingles per product of matrices in the pairwise step.
COLUMNS = 4_096
#: Rows of (id, group) that are broadcast to pick texts for verification; beyond, a shuffle join.
MAX_BROADCAST_ROWS = 1_000_000
LEAST_GROUPS = 256
#: Links that find their components in tasks of so many, and up to how many in all.
EDGES_PER_TASK, SMALL_EDGES = 10_000, 2_000_000

_RNG = np.random.default_rng(77)
_STEP = _RNG.integers(1 << 62, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_SEEDS = _RNG.integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the centres of 2**16 equal steps (Newton on 1 - (1+x)e^-x)."""
    u = (np.arange(1 << 16) + 0.5) / (1 << 16)
    lo, hi = np.zeros_like(u), np.full_like(u, 60.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < u
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


_GAMMA = _gamma_quantiles()
_R, _INVERSE_R, _LOG_C = _GAMMA.astype(np.float32), (1 / _GAMMA).astype(np.float32), np.log(_GAMMA).astype(np.float32)


# ---- shingles --------------------------------------------------------------


def shingles(part: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row (sorted), their counts, and row numbers.

    A row of fewer than ``SHINGLE`` words, but not none, has one shingle.
    """
    starts, ends, row = word_spans(part, offsets)
    n = len(starts)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    words = span_hash(prefix_hash(LOWER[part]), starts, ends)
    total = words * _STEP[0]
    whole = np.ones(n, dtype=bool)
    for j in range(1, SHINGLE):
        same = np.zeros(n, dtype=bool)
        same[: n - j] = row[j:] == row[: n - j]
        shifted = np.zeros(n, dtype=np.uint64)
        shifted[: n - j] = words[j:] * _STEP[j]
        total += np.where(same, shifted, np.uint64(0))
        whole &= same
    first = np.concatenate([[True], row[1:] != row[:-1]])
    counts = np.bincount(row, minlength=len(offsets) - 1)
    whole |= first & (counts[row] < SHINGLE)
    h, row = mix64(total[whole]), row[whole]
    order = np.argsort(h)
    order = order[np.argsort(row[order].astype(np.uint16) if len(offsets) < 1 << 16 else row[order], kind="stable")]
    h, row = h[order], row[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]))
    return h[new], np.diff(np.append(new, len(h))), row[new]


def cell_counts(frame: DataFrame) -> np.ndarray:
    """Distinct shingles of all documents per hash cell, summed in two steps."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for _, _, part, offs in blocks(data, offsets):
                h, _, _ = shingles(part, offs)
                cells += np.bincount((h & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        if cells.any():
            salt = TaskContext.get().partitionId() % 1024
            chunks = range(0, CELLS, CELL_CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array([a // CELL_CHUNK for a in chunks], pa.int32()), pa.array([salt for _ in chunks], pa.int32()), pa.array([zstandard.compress(cells[a : a + CELL_CHUNK].tobytes(), 1) for a in chunks], pa.binary())], ["chunk", "salt", "cells"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CELL_CHUNK, dtype=np.int64)
        for blob in table.column("cells"):
            total += np.frombuffer(zstandard.decompress(blob.as_py()), dtype=np.int64)
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "cells": pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())})

    sums = frame.select("text").mapInArrow(lean(count), "chunk int, salt int, cells binary").groupBy("chunk", "salt").applyInArrow(lean_group(add), "chunk int, cells binary").groupBy("chunk").applyInArrow(lean_group(add), "chunk int, cells binary")
    out = np.zeros(CELLS, dtype=np.int64)
    for r in sums.collect():
        out[r["chunk"] * CELL_CHUNK :][:CELL_CHUNK] = np.frombuffer(zstandard.decompress(bytes(r["cells"])), dtype=np.int64)
    return out


@dataclass(frozen=True)
class Idf:
    """Weights of common shingles, sorted by hash; all others weigh 2."""

    cells: np.ndarray
    hashes: np.ndarray
    weights: np.ndarray

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), 2, dtype=np.float32)
        maybe = np.flatnonzero(self.cells[(h & np.uint64(CELLS - 1)).astype(np.int64)])
        if len(maybe) and len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            same = self.hashes[at] == h[maybe]
            out[maybe[same]] = self.weights[at[same]]
        return out


def idf_weights(frequencies: np.ndarray, documents: int, share: float) -> np.ndarray:
    return (1 + np.clip(np.log((documents + 1) / (frequencies + 1)) / np.log(1 / share), 0, 1)).astype(np.float32)


def inverse_frequencies(frame: DataFrame) -> Idf:
    """Exact inverse document frequencies of all shingles that are common."""
    documents = frame.count()
    counted = cell_counts(frame)
    share = max(SHARE, counted.sum() / max(1, documents) / COMMON)
    least = share * (documents + 1) - 1
    open_cells = counted >= max(1, least)
    held = frame.sparkSession.sparkContext.broadcast(open_cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for _, _, part, offs in blocks(data, offsets):
                h, _, _ = shingles(part, offs)
                found, n = np.unique(h[held.value[(h & np.uint64(CELLS - 1)).astype(np.int64)]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    found = frame.select("text").mapInArrow(lean(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= float(least)).toPandas()
    h, n = found["h"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return Idf(open_cells, h[order], idf_weights(n[order], documents, share))


def weights_of(h: np.ndarray, counts: np.ndarray, idf: Idf) -> np.ndarray:
    return counts.astype(np.float32) * idf.of(h)


def samples(h: np.ndarray, weights: np.ndarray, heads: np.ndarray, occurrences: np.ndarray | None = None) -> np.ndarray:
    """Samples, one column per draw (by weights, then by occurrences if given), of the rows that begin at ``heads``."""
    log_weights = np.log(weights)
    log_occurrences = log_weights if occurrences is None else np.log(occurrences.astype(np.float32))
    counts = np.diff(np.append(heads, len(h)))
    segment = np.repeat(np.arange(len(heads)), counts)
    out = np.empty((len(heads), len(_SEEDS)), dtype=np.uint64)
    for k, seed in enumerate(_SEEDS):
        log_w = log_weights if k < BY_WEIGHT * ROWS else log_occurrences
        z = h * seed
        z ^= z >> np.uint64(32)
        z *= _ODD
        a = (z >> np.uint64(48)).astype(np.int32)
        b = ((z >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int32)
        beta = ((z >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
        r = _R[a]
        t = np.floor(log_w * _INVERSE_R[a] + beta)
        # ln a = ln c - ln y - r with ln y = r (t - beta)
        log_a = _LOG_C[b] - r * (t - beta + 1)
        least = np.minimum.reduceat(log_a, heads)
        hit = np.flatnonzero(log_a == least[segment])
        hit = hit[np.concatenate([[True], segment[hit][1:] != segment[hit][:-1]])]
        out[:, k] = mix64(h[hit] + t[hit].astype(np.int64).view(np.uint64) * seed)
    return out


def bands(drawn: np.ndarray) -> np.ndarray:
    keys = np.empty((len(drawn), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        key = np.full(len(drawn), b + 1, dtype=np.uint64)
        for r in range(ROWS):
            key = mix64(key * _ODD + drawn[:, b * ROWS + r])
        keys[:, b] = key
    return keys


def signatures(frame: DataFrame, idf) -> DataFrame:
    """``doc_id, body, keys``: a digest of the text and its band keys (none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            keys: list = [[] for _ in range(batch.num_rows)]
            for i, _, part, offs in blocks(data, offsets):
                h, counts, row = shingles(part, offs)
                if len(h):
                    heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    for r, k in zip((i + row[heads]).tolist(), bands(samples(h, weights_of(h, counts, idf.value), heads, counts)).view(np.int64)):
                        keys[r] = k
            body = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(body, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "body", "keys"])

    return frame.mapInArrow(lean(run), "doc_id long, body binary, keys array<long>")


# ---- verification ----------------------------------------------------------


@dataclass(frozen=True)
class Shingled:
    """A text's sorted shingle hashes with weights, occurrences and the sums of both."""

    hashes: np.ndarray
    weights: np.ndarray
    counts: np.ndarray
    weight: float
    count: int


def alike(a: Shingled, b: Shingled) -> bool:
    """Whether either weighted Jaccard similarity reaches ``SIMILARITY``."""
    if min(a.weight, b.weight) < SIMILARITY * max(a.weight, b.weight) - 1e-6 and min(a.count, b.count) < SIMILARITY * max(a.count, b.count):
        return False
    _, i, j = np.intersect1d(a.hashes, b.hashes, assume_unique=True, return_indices=True)
    both = float(np.minimum(a.weights[i], b.weights[j]).sum(dtype=np.float64))
    if both >= (SIMILARITY - 1e-9) * (a.weight + b.weight - both):
        return True
    both = int(np.minimum(a.counts[i], b.counts[j]).sum(dtype=np.int64))
    return both >= (SIMILARITY - 1e-9) * (a.count + b.count - both)


def close_pairs(sets: list[Shingled], labels: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of different labels that reach ``SIMILARITY`` but for rounding.

    Occurrence t of a shingle is a column of its own, so that shared weights of
    all pairs are products of 0/1 matrices; columns of one text alone are left
    out, the others are taken ``COLUMNS`` at a time.
    """
    n = len(sets)
    owner = np.repeat(np.arange(n), [s.count for s in sets])
    counts = np.concatenate([s.counts for s in sets]).astype(np.int64)
    turn = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint64)
    key = np.repeat(np.concatenate([s.hashes for s in sets]), counts)
    key = np.where(turn > 0, mix64(key + turn * _ODD), key)
    weight = np.repeat(np.concatenate([s.weights for s in sets]) / np.maximum(counts, 1), counts).astype(np.float32)
    order = np.argsort(key, kind="stable")
    key, owner, weight = key[order], owner[order], weight[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(key)))
    shared = np.repeat(size > 1, size)
    column = np.repeat(np.cumsum(size > 1) - 1, size)[shared]
    owner, weight = owner[shared], weight[shared]
    both, both_w = np.zeros((n, n), np.float32), np.zeros((n, n), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, lo), np.searchsorted(column, lo + COLUMNS)
        there = np.zeros((n, min(COLUMNS, int(column[-1]) + 1 - lo)), np.float32)
        there[owner[a:b], column[a:b] - lo] = 1
        heavy = np.zeros(there.shape[1], np.float32)
        heavy[column[a:b] - lo] = weight[a:b]
        both += there @ there.T
        both_w += (there * heavy) @ there.T
    count, total = (np.array(x, np.float32) for x in ([s.count for s in sets], [s.weight for s in sets]))
    least = SIMILARITY - 1e-3
    close = (both >= least * (count[:, None] + count[None, :] - both)) | (both_w >= least * (total[:, None] + total[None, :] - both_w))
    i, j = np.nonzero(np.triu(close, 1) & (labels[:, None] != labels[None, :]))
    return list(zip(i.tolist(), j.tolist()))


def _set_rows(frame: DataFrame, wanted: DataFrame, few: bool) -> DataFrame:
    """``g, tag, node, words`` for every (node, g, tag) wanted, from the nodes' whole texts.

    ``words`` are the sorted shingle hashes and their counts, compressed.
    """
    lists = wanted.groupBy("node").agg(F.collect_list(F.struct("g", "tag")).alias("places"))
    chosen = frame.join(F.broadcast(lists) if few else lists, frame["doc_id"] == lists["node"]).select("node", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            sets = [b""] * batch.num_rows
            for i, _, part, offs in blocks(data, offsets):
                h, counts, row = shingles(part, offs)
                bounds = np.searchsorted(row, np.arange(len(offs)))
                for r in range(len(offs) - 1):
                    a, b = bounds[r], bounds[r + 1]
                    sets[i + r] = zstandard.compress(np.diff(h[a:b], prepend=np.uint64(0)).tobytes() + counts[a:b].astype(np.uint32).tobytes(), 1)
            places = batch.column(2)
            sizes = np.diff(places.offsets.to_numpy())
            at = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            flat = places.flatten()
            yield pa.RecordBatch.from_arrays([flat.field("g"), flat.field("tag"), batch.column(0).take(at), pa.array(sets, pa.binary()).take(at)], ["g", "tag", "node", "words"])

    return chosen.mapInArrow(lean(run), "g long, tag long, node long, words binary")


def _unpacked(blob: bytes, idf: np.ndarray) -> Shingled:
    raw = zstandard.decompress(blob)
    n = len(raw) // 12
    h = np.cumsum(np.frombuffer(raw, np.uint64, n), dtype=np.uint64)
    counts = np.frombuffer(raw, np.uint32, n, 8 * n)
    w = weights_of(h, counts, idf)
    return Shingled(h, w, counts, float(w.sum(dtype=np.float64)), int(counts.sum(dtype=np.int64)))


_LINKS = "a long, b long"


def _links(pairs: list[tuple[int, int]]) -> pa.Table:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _by_size(wanted: DataFrame) -> tuple[DataFrame, bool]:
    wanted = checkpoint(wanted)
    return wanted, wanted.count() <= MAX_BROADCAST_ROWS


def star_pairs(members: DataFrame) -> DataFrame:
    """``node, least``: each node with the least node of each of its buckets."""
    least = members.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key", "least")
    return members.join(least, "key").where("node <> least").select("node", "least").distinct()


def link_to_least(frame: DataFrame, pairs: DataFrame, idf) -> DataFrame:
    """Compare the nodes of each pair ``node, least``; verified links ``a < b``."""
    pairs = checkpoint(pairs)
    # Only popular least nodes need several groups; there is one for MEMBERS pairs at most.
    popular = checkpoint(pairs.groupBy("least").agg(F.ceil(F.count("*") / MEMBERS).alias("shares")).where("shares > 1"))
    groups = max(LEAST_GROUPS, pairs.count() // MEMBERS)
    side = F.broadcast(popular) if popular.count() <= MAX_BROADCAST_ROWS else popular
    dealt = pairs.join(side, "least", "left").withColumn("share", F.pmod(F.xxhash64("node"), F.coalesce("shares", F.lit(1)))).withColumn("g", F.pmod(F.xxhash64("least", "share"), F.lit(groups)))
    wanted = dealt.select("node", "g", F.col("least").alias("tag")).unionByName(dealt.select(F.col("least").alias("node"), "g", F.col("least").alias("tag")).distinct())

    def verify(table: pa.Table) -> pa.Table:
        tags, nodes, blobs = table.column("tag").to_numpy(), table.column("node").to_numpy(), table.column("words")
        order = np.lexsort([nodes != tags, tags])
        found, tag, own = [], None, None
        for i in order.tolist():
            if tags[i] != tag:
                # The least node comes first; repeated rows of it don't matter.
                tag, own = tags[i], _unpacked(blobs[i].as_py(), idf.value) if nodes[i] == tags[i] else None
            if own is not None and nodes[i] != tag and alike(own, _unpacked(blobs[i].as_py(), idf.value)):
                found.append((int(tag), int(nodes[i])))
        return _links(found)

    return _set_rows(frame, *_by_size(wanted)).groupBy("g").applyInArrow(lean_group(verify), _LINKS)


def link_across(frame: DataFrame, members: DataFrame, labels: DataFrame, idf) -> DataFrame:
    """Compare the nodes of different components in buckets that hold several."""
    named = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    open_ = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("mark")).where("lo < hi")
    # Buckets of equal nodes are compared once.
    open_, few = _by_size(open_.groupBy("n", "mark").agg(F.min("key").alias("key")).select("key"))
    rows = named.join(F.broadcast(open_) if few else open_, "key")
    per, _ = _by_size(rows.groupBy("key", "label").agg(F.count("*").alias("m")))
    is_big = F.col("m") > BLOCK_NODES
    shares = F.ceil(F.col("m") / BLOCK_NODES)
    big, few_big = _by_size(per.where(is_big).select("key", "label", shares.alias("shares")))
    layout, few_keys = _by_size(per.groupBy("key").agg(F.coalesce(F.ceil(F.sum(F.when(~is_big, F.col("m"))) / BLOCK_NODES), F.lit(0)).alias("small"), F.collect_list(F.when(is_big, F.struct("label", shares.alias("n")))).alias("bigs")))
    rows = rows.join(F.broadcast(big) if few_big else big, ["key", "label"], "left").join(F.broadcast(layout) if few_keys else layout, "key")

    def places(n: Column, block) -> Column:
        return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), block)).otherwise(F.array().cast("array<long>"))

    small = lambda i: F.xxhash64(F.lit(-1), i.cast("long"))
    own = F.when(F.col("shares").isNull(), small(F.pmod(F.xxhash64("label"), F.greatest("small", F.lit(1))))).otherwise(F.xxhash64("label", F.pmod(F.xxhash64("node"), F.col("shares")).cast("long")))
    # A node meets the blocks of small components and those of all big ones but its own.
    foreign = F.flatten(F.transform(F.filter("bigs", lambda x: x["label"] != F.col("label")), lambda x: places(x["n"], lambda i: F.xxhash64(x["label"], i.cast("long")))))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.concat(foreign, places(F.col("small"), small))))
    rows = checkpoint(rows.select("node", "label", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("tag")))
    groups = max(LEAST_GROUPS, rows.count() // MEMBERS)
    place = rows.select("node", F.pmod(F.xxhash64("tag"), F.lit(groups)).alias("g"), "tag")

    def verify(table: pa.Table) -> pa.Table:
        tags, nodes, labels_, blobs = (table.column(c) for c in ("tag", "node", "label", "words"))
        tags, nodes, labels_ = tags.to_numpy(), nodes.to_numpy(), labels_.to_numpy()
        found = []
        order = np.lexsort([nodes, tags])
        cuts = np.flatnonzero(np.concatenate([[True], tags[order][1:] != tags[order][:-1]]))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
            rows = order[a:b]
            parent = {int(x): int(x) for x in labels_[rows]}

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            sets = [_unpacked(blobs[i].as_py(), idf.value) for i in rows.tolist()]
            for i, j in close_pairs(sets, labels_[rows]):
                p, q = root(int(labels_[rows[i]])), root(int(labels_[rows[j]]))
                if p != q and alike(sets[i], sets[j]):
                    parent[max(p, q)] = min(p, q)
                    found.append((int(min(nodes[rows[i]], nodes[rows[j]])), int(max(nodes[rows[i]], nodes[rows[j]]))))
        return _links(found)

    named_sets = _set_rows(frame, *_by_size(place)).join(labels, "node", "left").select("g", "tag", "node", F.coalesce("label", "node").alias("label"), "words")
    return named_sets.groupBy("g").applyInArrow(lean_group(verify), _LINKS)


# ---- components ------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the least node of each component, for nodes that have links.

    Up to ``SMALL_EDGES`` links are dealt to one task per ``EDGES_PER_TASK``,
    once for each end, whatever the session's number of partitions; more go
    through its partitions, where adaptive joins split popular nodes.
    """
    edges = checkpoint(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    n = edges.count()

    def placed(rows: DataFrame) -> DataFrame:
        return rows.repartition(4 + n // EDGES_PER_TASK, "u") if n <= SMALL_EDGES else rows

    edges = placed(edges).distinct()
    seen = None
    while True:
        # Large star: larger neighbours of u go to the least of u and its neighbours.
        both = placed(edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = placed(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")).distinct()
        # Small star: u and its smaller neighbours go to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = checkpoint(placed(small).distinct())
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == seen:
            break
        seen = state
    roots = placed(edges.select(F.col("v").alias("u"))).distinct().select(F.col("u").alias("node"), F.col("u").alias("label"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


# ---- the operator ----------------------------------------------------------


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, kept`` per row; ``kept`` marks the row whose id names the class."""
    frame = id_and_text(docs)
    context = frame.sparkSession.sparkContext
    idf = context.broadcast(inverse_frequencies(frame))
    signed = checkpoint(signatures(frame.where("doc_id is not null"), idf))
    bodies = signed.groupBy("body").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last"), F.min("keys").alias("keys"))
    members = checkpoint(bodies.select("node", F.explode("keys").alias("key")).distinct())
    # Rows that share an id but not a text tie their texts together.
    ties = signed.select("doc_id", "body").distinct().groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    tied = signed.join(ties, "doc_id", "left_semi").join(bodies.select("body", "node"), "body").where("node <> doc_id").select(F.col("node").alias("a"), F.col("doc_id").alias("b")).distinct()
    pairs = checkpoint(star_pairs(members))
    first = pairs.groupBy("node").agg(F.min("least").alias("least"))
    labels = checkpoint(components(link_to_least(frame, first, idf).unionByName(tied)))

    def linked_with(more: DataFrame) -> DataFrame:
        stars = labels.where("node <> label").select(F.col("label").alias("a"), F.col("node").alias("b"))
        return checkpoint(components(stars.unionByName(more)))

    # Pairs of the first round that failed are not tried again.
    name = {c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")) for c in ("node", "least")}
    apart = pairs.join(first, ["node", "least"], "left_anti").join(name["node"], "node", "left").join(name["least"], "least", "left")
    apart = checkpoint(apart.where(F.coalesce("node_label", "node") != F.coalesce("least_label", "least")).select("node", "least"))
    if not apart.isEmpty():
        labels = linked_with(link_to_least(frame, apart, idf))
    rest = checkpoint(link_across(frame, members, labels, idf))
    if not rest.isEmpty():
        labels = linked_with(rest)
    classes = bodies.select("body", "node").join(labels, "node", "left").select("body", F.coalesce("label", "node").alias("class_id"))
    found = signed.select("doc_id", "body").join(classes, "body").select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    missing = frame.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"))
    return found.unionByName(missing)


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each class, columns unchanged; rows of a null id stay.

    Of several rows with the id that names a class the one with the least text stays.
    """
    classes = checkpoint(near_duplicates(docs))
    gone = classes.where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    few = gone.count() <= MAX_BROADCAST_ROWS
    left = docs.join(F.broadcast(gone) if few else gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")
    kept = classes.where("kept and doc_id is not null")
    if kept.count() != kept.distinct().count():
        one = left.where("doc_id is not null").groupBy("doc_id").agg(F.min_by(F.struct(*left.columns), F.coalesce("text", F.lit(""))).alias("row")).select("row.*")
        left = one.select(*left.columns).unionByName(left.where("doc_id is null"))
    return left
