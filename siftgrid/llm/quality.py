"""Quality by interpolated modified Kneser-Ney models over words (operator 10).

The models are trained on trusted texts (``labels.quality`` = 1) of the whole
table.  The first has order 3 over tokens: runs of word bytes and
runs of other bytes, as they are written (only a single space between tokens
is none).  Its n-grams grow with the input, so they are never collected or
broadcast whole.  The ``MAX_KNOWN`` most frequent trained tokens are broadcast
and travel as their ranks, other trained ones as hashes.  The trigrams of trained
texts travel packed, to the shard of their middle token, to be counted: it holds
all contexts of order 3, and the bigrams that begin with the token.  A token
that is over half of a shard's share is spread over shards by the token before
it, and its bigrams are summed in shards of their own.  Then the trigrams of
all texts meet the counts.  A token's loss by itself is known where its text
is, or in its hash's shard; a shard tells what its bigrams and trigrams change
of that, which is packed and summed by row.

A token that no trained text has is spelled by the second model, of order
``ORDER`` over ``ALPHABET`` character classes; that one has at most 64**4 =
16.8 million n-grams whatever the input, and is broadcast.  A seen token is
not also spelled (the words back off to characters, they don't interpolate).

A fifth of the trusted documents (by hash of the id) is not trained on but
calibrates: a document's perplexity per character is compared with a quantile
of those of its language, and so is that by the characters alone: a text is
kept if neither its words nor its spelling is unusual.  A language with fewer than ``MIN_CALIBRATION`` of
them takes the threshold of all languages if that is higher.  For that decision the mean log-loss is
drawn to the language's trusted mean by ``PRIOR_CHARS`` characters, so that a
few unusual letters of a short text don't decide.

Defined results: a null or empty text has perplexity null and is kept only if
nothing speaks against it: it is *not* kept (there is nothing to learn from
it).  Null languages form a group of their own; a group without trusted
documents takes the threshold of all.  Without any trusted document perplexity
is 64 (uniform) and every non-empty text is kept.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_WORD, blocks, checkpoint, lean, lean_group, mix64, prefix_hash, span_hash, text_buffers

ORDER = 4
BITS = 6
ALPHABET = 1 << BITS
CELLS = 1 << (BITS * ORDER)
#: Characters of all texts per shard of n-grams, and bytes of texts whose n-grams are packed at a time.
SHARD_CHARS, BAG_BYTES = 32_000_000, 8_000_000
#: Trained tokens that are broadcast (16 bytes each); the others travel by their hashes.
MAX_KNOWN = 1 << 21
QUANTILE = 0.99
PRIOR_CHARS = 40
#: Trusted ids are broadcast up to this number (8 bytes each), else joined by shuffle.
MAX_BROADCAST_IDS = 2_000_000
#: Width of a histogram bin of the mean log-loss.
BIN = 0.002
MIN_CALIBRATION = 25


def _classes() -> np.ndarray:
    out = np.full(256, 39, dtype=np.uint8)
    out[97:123] = np.arange(1, 27)
    out[65:91] = 27
    out[48:58] = 28
    out[[32, 9]] = 29
    out[10] = 30
    for code, chars in enumerate((".", ",", "'", '"', "-", "!?", ":;", "()"), 31):
        out[[ord(c) for c in chars]] = code
    out[128:192] = 40 + np.arange(64) % 24
    return out


CLASS = _classes()
IS_LEAD = np.zeros(256, dtype=bool)
IS_LEAD[192:] = True


def codes(part: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-gram codes of a block and the row bounds in them; lead bytes don't count."""
    unit = ~IS_LEAD[part]
    kept = np.zeros(len(part) + 1, dtype=np.int64)
    np.cumsum(unit, out=kept[1:])
    bounds = kept[offsets]
    symbols = CLASS[part[unit]].astype(np.int32)
    code = symbols.copy()
    heads = bounds[:-1]
    for back in range(1, ORDER):
        older = np.zeros_like(symbols)
        older[back:] = symbols[: len(symbols) - back] if back < len(symbols) else 0
        for ahead in range(back):
            at = heads + ahead
            older[at[at < np.minimum(bounds[1:], len(older))]] = 0
        code |= older << (BITS * back)
    return code, bounds


def ngram_counts(docs: DataFrame) -> DataFrame:
    """``code, n``: n-grams over all texts, summed per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.int32)
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for _, _, part, offs in blocks(data, offsets):
                code, n = np.unique(codes(part, offs)[0], return_counts=True)
                total[code] += n
        found = np.flatnonzero(total)
        for i in range(0, len(found), 100_000):
            part = found[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part].astype(np.int64))], ["code", "n"])

    return docs.select("text").mapInArrow(lean(run), "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def discounts(counts_of_counts: dict[int, int]) -> tuple[float, float, float]:
    """D1, D2 and D3+ of modified Kneser-Ney; where counts are missing, 0.5, 1.0, 1.5."""
    n1, n2, n3, n4 = (counts_of_counts.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, max(n4, 1))))


def probabilities(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For orders 1 to ORDER: seen n-grams with their share, and contexts with what they leave.

    The first table of an order is ``code, p`` - the probability of the last
    symbol given the others, interpolated with all lower orders - and the
    second ``context, gamma``, the weight of the next lower order.
    """
    grams = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        grams[order] = grams[order + 1].groupBy(F.col("code").bitwiseAND((1 << (BITS * order)) - 1).alias("code")).agg(F.count("*").alias("n"))
    out: list[tuple[DataFrame, DataFrame]] = []
    for order in range(1, ORDER + 1):
        table = grams[order]
        d1, d2, d3 = discounts({r["n"]: r["k"] for r in table.where("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()})
        context = F.shiftright("code", BITS)
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        table = table.select("code", context.alias("context"), "n", cut.alias("cut"))
        totals = table.groupBy("context").agg(F.sum("n").alias("all"), F.sum("cut").alias("left"))
        rest = totals.select("context", (F.col("left") / F.col("all")).alias("gamma"))
        joined = table.join(totals, "context").select("code", "context", ((F.col("n") - F.col("cut")) / F.col("all")).alias("own"), (F.col("left") / F.col("all")).alias("gamma"))
        if order == 1:
            p = joined.select("code", (F.col("own") + F.col("gamma") / ALPHABET).alias("p"))
        else:
            lower = out[-1][0].select(F.col("code").alias("suffix"), F.col("p").alias("p_lower"))
            p = joined.withColumn("suffix", F.col("code").bitwiseAND((1 << (BITS * (order - 1))) - 1)).join(lower, "suffix").select("code", (F.col("own") + F.col("gamma") * F.col("p_lower")).alias("p"))
        out.append((checkpoint(p), checkpoint(rest)))
    return out


class Losses:
    """-log p of every possible n-gram, made dense on the executor from the seen ones."""

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.orders = orders
        self.table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"orders": self.orders, "table": None}

    def dense(self) -> np.ndarray:
        if self.table is None:
            lower = np.full(1, 1.0 / ALPHABET, dtype=np.float32)
            for order, (code, p, context, gamma) in enumerate(self.orders, 1):
                left = np.ones(1 << (BITS * (order - 1)), dtype=np.float32)
                left[context] = gamma
                # p(unseen | context) = gamma(context) * p(last | shorter context)
                if order == 1:
                    full = np.full(ALPHABET, left[0] / ALPHABET, dtype=np.float32)
                else:
                    full = (left.reshape(ALPHABET, -1)[:, :, None] * lower.reshape(1, -1, ALPHABET)).reshape(-1).astype(np.float32)
                full[code] = p
                lower = full
            self.table = -np.log(np.maximum(lower, 1e-12, out=lower), out=lower)
        return self.table


def train(trusted: DataFrame) -> Losses:
    tables = []
    for p, rest in probabilities(checkpoint(ngram_counts(trusted))):
        a, b = p.toPandas(), rest.toPandas()
        tables.append((a["code"].to_numpy(np.int32), a["p"].to_numpy(np.float32), b["context"].to_numpy(np.int32), b["gamma"].to_numpy(np.float32)))
    return Losses(tables)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Distinct ids of trusted documents, marked for broadcast only while they are few."""
    ids = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    ids = ids.withColumn("calibrates", F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0)
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids


# ---- words -----------------------------------------------------------------

_STEP = np.random.default_rng(10).integers(1 << 62, 1 << 63, 3, dtype=np.uint64) | np.uint64(1)
#: Codes of tokens: one that no trained text has, what stands before the first of a text, and, as
#: first tokens, what tells that a pair or a token is to be scored alone; known tokens follow.
_UNKNOWN, _BEGIN, _PAIR, _ALONE, _KNOWN = (np.uint64(x) for x in range(5))
#: The bit of codes that are hashes: of tokens that are not known and may be trained.
_HASHED = np.uint64(1 << 63)
#: Steps of a unit of log-loss in which the spelling of a token is kept.
_SPELL_STEPS = 64
#: Bits of known tokens whose counts are summed in one task.
_RANGE = np.uint64(16)
#: A task looks for heavy tokens in one block of so many.
_SAMPLED = 8


def token_spans(part: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the tokens of a block."""
    if not len(part):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = IS_WORD[part]
    heads = offsets[:-1]
    first = np.ones(len(part), dtype=bool)
    np.not_equal(inside[1:], inside[:-1], out=first[1:])
    first[heads[heads < len(part)]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(part))
    kept = (ends - starts > 1) | (part[starts] != 32)
    starts, ends = starts[kept], ends[kept]
    return starts, ends, np.repeat(np.arange(len(heads)), np.diff(np.searchsorted(starts, offsets)))


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * _STEP[0] + b * _STEP[1])


def _place(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def _groups(*columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns differ from the row before."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = False
        for x in columns:
            new[1:] |= x[1:] != x[:-1]
    return new


def _steps(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Differences to the row before, from 0 in each group."""
    out = x.copy()
    out[1:] -= np.where(new[1:], 0, x[:-1])
    return out.astype(np.uint32)


def _rise(steps: np.ndarray, new: np.ndarray) -> np.ndarray:
    """What :func:`_steps` was given."""
    total = np.cumsum(steps, dtype=np.int64)
    at = np.flatnonzero(new)
    return total - np.repeat(total[at] - steps[at], np.diff(np.append(at, len(steps))))


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns, byte by byte, compressed."""
    sizes = np.array([len(c) for c in columns], dtype=np.int64).tobytes()
    return zstandard.compress(sizes + b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns), 3)


def _unpack(blob: bytes, kinds: tuple) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    at, out = 8 * len(kinds), []
    for n, kind in zip(raw[:at].view(np.int64).tolist(), map(np.dtype, kinds)):
        out.append(np.ascontiguousarray(raw[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T).view(kind).ravel())
        at += n * kind.itemsize
    return out


def _pack_counts(keys: np.ndarray, n: np.ndarray) -> bytes:
    return _pack([np.diff(keys, prepend=np.uint64(0)), n.astype(np.uint32)])


def _unpack_counts(blobs: list) -> tuple[np.ndarray, np.ndarray]:
    """Different keys of all blobs, in order, and their summed counts."""
    parts = [_unpack(x.as_py(), (np.uint64, np.uint32)) for x in blobs]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return _sums(np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in parts]), np.concatenate([n for _, n in parts]))


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(keys)
    at = np.flatnonzero(_groups(keys[by]))
    return keys[by][at], np.add.reduceat(n[by].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)


def spelling(part: np.ndarray, offs: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Summed loss of the characters before each byte."""
    code, _ = codes(part, offs)
    total = np.zeros(len(code) + 1)
    np.cumsum(table[code], dtype=np.float64, out=total[1:])
    at = np.zeros(len(part) + 1, dtype=np.int64)
    np.cumsum(~IS_LEAD[part], out=at[1:])
    return total[at]


def spelled(total: np.ndarray, starts: np.ndarray, row: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Loss of each token's characters (and of blanks next to it), in whole steps."""
    first = np.concatenate([[True], row[1:] != row[:-1]])
    last = np.append(first[1:], True)
    begin = np.where(first, offs[row], starts)
    return np.round((total[np.where(last, offs[row + 1], np.append(begin[1:], 0))] - total[begin]) * _SPELL_STEPS).astype(np.int64)


def heavy_words(docs: DataFrame, shards: int) -> np.ndarray:
    """Hashes of tokens that may be over half of a shard's share of all tokens; four a shard at most.

    Each task tells of its first block and of one in ``_SAMPLED`` after it, and
    a block only of its tokens above a quarter of that share, so a token above
    half of it has a sum above a quarter at least.  Which tokens are heavy
    decides where trigrams travel and changes no result.
    """
    if shards == 1:
        return np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for _, _, part, offs in blocks(data, offsets):
                at += 1
                starts, ends, _ = token_spans(part, offs) if at % _SAMPLED == 1 else token_spans(part[:0], offs[:1])
                if len(starts):
                    word, n = np.unique(span_hash(prefix_hash(part), starts, ends), return_counts=True)
                    often = n > len(starts) / (4 * shards)
                    # The null row tells the number of all tokens.
                    yield pa.RecordBatch.from_arrays([pa.array([None, *word[often].view(np.int64).tolist()], pa.int64()), pa.array([len(starts), *n[often].tolist()], pa.int64())], ["word", "n"])

    counts = docs.select("text").mapInArrow(lean(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = checkpoint(counts)
    total = counts.where("word is null").agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("word").isNotNull() & (F.col("n") > total / (4 * shards))).select("word").collect()
    return np.sort(np.array([r["word"] for r in found], dtype=np.int64).view(np.uint64))


class Words:
    """The known tokens: trained ones, and all of these if they are ``whole``.

    A known token's code is its rank by frequency.  Any other is unknown if the
    known ones are all or if it is heavy (trained heavy ones are known), else
    its code is its hash.
    """

    def __init__(self, hashes: np.ndarray, n: np.ndarray, whole: bool, heavy: np.ndarray) -> None:
        by = np.lexsort((hashes, -n))
        rank = np.empty(len(by), dtype=np.uint32)
        rank[by] = np.arange(len(by), dtype=np.uint32)
        order = np.argsort(hashes)
        self.hashes, self.rank, self.whole, self.heavy = hashes[order], rank[order], whole, heavy

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        other = np.zeros(len(hashes), np.uint64) if self.whole else np.where(np.isin(hashes, self.heavy), _UNKNOWN, hashes | _HASHED)
        if not len(self.hashes):
            return other
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.rank[at].astype(np.uint64) + _KNOWN, other)


def known_words(trained: DataFrame, shards: int, heavy: np.ndarray) -> Words:
    """The most frequent trained tokens, ``MAX_KNOWN`` or so (by shares of the hashes' ranges), and heavy ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n_bytes = [], 0

        def packed() -> pa.RecordBatch:
            word, n = _sums(*(np.concatenate(x) for x in zip(*parts)))
            at = _place(word, shards)
            found = np.unique(at)
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array([_pack_counts(word[at == i], n[at == i]) for i in found], pa.binary())], ["shard", "blob"])

        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for _, _, part, offs in blocks(data, offsets):
                starts, ends, _ = token_spans(part, offs)
                if len(starts):
                    parts.append(np.unique(span_hash(prefix_hash(part), starts, ends), return_counts=True))
            n_bytes += len(data)
            if n_bytes >= 2 * BAG_BYTES and parts:
                yield packed()
                parts, n_bytes = [], 0
        if parts:
            yield packed()

    most = MAX_KNOWN // shards

    def chosen(table: pa.Table) -> pa.Table:
        word, n = _unpack_counts(table.column("blob"))
        kept = np.isin(word, heavy)
        kept[np.lexsort((word, -n))[:most]] = True
        return pa.table({"blob": pa.array([_pack_counts(word[kept], n[kept])], pa.binary()), "whole": pa.array([bool(kept.all())])})

    found = trained.select("text").mapInArrow(lean(run), "shard long, blob binary").groupBy("shard").applyInArrow(lean_group(chosen), "blob binary, whole boolean").collect()
    parts = [_unpack(bytes(r["blob"]), (np.uint64, np.uint32)) for r in found] or [(np.zeros(0, np.uint64), np.zeros(0, np.uint32))]
    return Words(np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in parts]), np.concatenate([n for _, n in parts]).astype(np.int64), all(r["whole"] for r in found), heavy)


_COUNT_KINDS = (np.uint64, np.uint32, np.uint32, np.uint32, np.uint32)
_SCORE_KINDS = (np.uint64, np.uint32, np.uint32, np.uint32, np.uint32, np.uint32, np.uint8)


def _pack_trigrams(known: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, *fields: np.ndarray) -> bytes:
    """Trigrams, in order of b, a and c, by the places of their tokens in the codes that they use."""
    used = np.zeros(len(known), dtype=bool)
    used[a] = used[b] = used[c] = True
    to = np.cumsum(used) - 1
    new_b, new_ab = _groups(b), _groups(b, a)
    a, b, c = to[a], to[b], to[c]
    return _pack([np.diff(known[used], prepend=np.uint64(0)), np.diff(b, prepend=0).astype(np.uint32), _steps(a, new_b), _steps(c, new_ab), *fields])


def _trigrams(blob: bytes, kinds: tuple) -> tuple[np.ndarray, ...]:
    """The three tokens of each trigram of a bag, and its further columns."""
    words, b, a, c, *rest = _unpack(blob, kinds)
    words = np.cumsum(words, dtype=np.uint64)
    new = b > 0
    new[:1] = True
    b, a = np.cumsum(b, dtype=np.int64), _rise(a, new)
    return words[a], words[b], words[_rise(c, _groups(b, a))], *rest


class Costs:
    """What is known of tokens alone: how many bigrams end with each known one, all that do, the first discounts, the loss of being unseen."""

    def __init__(self, ends: np.ndarray, all_ends: int, cut: tuple[float, float, float], unseen: float) -> None:
        self.ends, self.all_ends, self.cut, self.unseen = ends, all_ends, cut, unseen

    def share(self, code: np.ndarray, more: Table) -> np.ndarray:
        """Shares of tokens by their codes, 0 if unseen; ``more`` has the counts of hashed ones."""
        n = more.get(code, 0)[0].astype(np.int64)
        at = np.flatnonzero((code >= _KNOWN) & (code < _HASHED))
        n[at] = self.ends[(code[at] - _KNOWN).astype(np.int64)]
        return (n - _cuts(n, self.cut)) / max(self.all_ends, 1)


def bags(docs: DataFrame, shards: int, heavy: np.ndarray, words: Broadcast, spell: Broadcast | None = None, costs: Broadcast | None = None) -> DataFrame:
    """``shard, name, bag, info``: trigrams of about ``BAG_BYTES`` of texts at a time, packed by shard.

    A trigram is in the shard of its middle token, or of that and the token
    before it if the middle one is ``heavy`` (codes).  Without ``spell`` it
    comes once with how often it occurs.

    With ``spell`` (a :class:`Losses`) it comes once per occurrence, with the
    row in the bag; which rows are trained on is told in each shard.  A heavy
    middle token and the one after it come again as a pair, in the pair's
    shard; a hashed token comes again alone, in its own, with the loss of its
    spelling.  Where the middle token is unknown nothing is changed by a
    trigram, nor by one whose first token is unknown and whose middle one is
    heavy beyond the pair; these don't travel.  ``info`` has what is known of
    the rows, once a bag, with their tokens scored alone by ``costs`` (:class:`Costs`).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = spell.value.dense() if spell is not None else None
        batches_, grams, letters, chars, name, n_rows, n_bytes = [], [], [], [], hashlib.blake2b(digest_size=8), 0, 0

        def packed() -> pa.RecordBatch:
            word, row, cost = (np.concatenate(x) for x in zip(*grams)) if grams else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            word, at = np.unique(word, return_inverse=True)
            code = words.value.codes(word)
            known, to = np.unique(np.concatenate([code, [_UNKNOWN, _BEGIN, _PAIR, _ALONE]]), return_inverse=True)
            _, begin, pair, alone = to[len(code) :]
            last = to[: len(code)][at]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            middle, left = np.full_like(last, begin), np.full_like(last, begin)
            middle[1:] = np.where(place[1:] >= 1, last[:-1], begin)
            left[2:] = np.where(place[2:] >= 2, last[:-2], begin)
            del word, at, place
            spread = np.isin(known, heavy)
            # _UNKNOWN is the least code, so its place is 0.
            kept = np.flatnonzero((middle > 0) & ~(spread[middle] & (left == 0)))
            a, b, c, r = left[kept], middle[kept], last[kept], row[kept]
            shard = _place(mix64(known), shards)[b]
            apart = np.flatnonzero(spread[b])
            shard[apart] = _place(pair_key(known[a[apart]], known[b[apart]]), shards)
            if spell is not None:
                base = costs.value.share(known, Table(np.zeros(0, np.uint64), np.zeros(0)))
                base = np.where(base[last] > 0, -np.log(np.where(base > 0, base, 1.0))[last], cost / _SPELL_STEPS + costs.value.unseen)
                pairs, single = np.flatnonzero(spread[middle]), np.flatnonzero(known[last] >= _HASHED)
                price = np.concatenate([np.zeros(len(a) + len(pairs), np.int64), cost[single]])
                shard = np.concatenate([shard, _place(pair_key(known[middle[pairs]], known[last[pairs]]), shards), _place(mix64(known[last[single]]), shards)])
                a = np.concatenate([a, np.full(len(pairs), pair), np.full(len(single), alone)])
                b, c = np.concatenate([b, middle[pairs], last[single]]), np.concatenate([c, last[pairs], last[single]])
                r = np.concatenate([r, row[pairs], row[single]])
                total = np.bincount(row, base, n_rows)
                info = pa.Table.from_batches(batches_)
                info = info.append_column("chars", pa.array(np.concatenate(chars), pa.int64())).append_column("letters", pa.array(np.concatenate(letters), pa.float64()))
                # A text without tokens is scored by its characters.
                info = info.append_column("base", pa.array(np.where(np.bincount(row, minlength=n_rows) > 0, total, np.concatenate(letters))))
                flags = np.packbits(info.column("trained").to_numpy().astype(bool))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, info.schema) as out:
                    out.write_table(info)
            by = np.argsort((b << 42) | (a << 21) | c) if len(known) < 1 << 21 else np.lexsort((c, a, b))
            by = by[np.argsort(shard[by].astype(np.uint16) if shards < 1 << 16 else shard[by], kind="stable")]
            cuts = np.flatnonzero(_groups(shard[by]))
            blobs, infos = [], []
            for part in np.split(by, cuts[1:]) if len(by) or spell is not None else []:
                x, y, z = a[part], b[part], c[part]
                if spell is None:
                    new = np.flatnonzero(_groups(x, y, z))
                    blobs.append(_pack_trigrams(known, x[new], y[new], z[new], np.diff(np.append(new, len(part))).astype(np.uint32)))
                    infos.append(None)
                else:
                    blobs.append(_pack_trigrams(known, x, y, z, r[part].astype(np.uint32), price[part].astype(np.uint32), flags))
                    infos.append(None if infos else zstandard.compress(sink.getvalue()))
            at = shard[by][cuts] if len(by) else np.zeros(len(blobs), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), np.frombuffer(name.digest(), np.int64)[0])), pa.array(blobs, pa.binary()), pa.array(infos, pa.binary())], ["shard", "name", "bag", "info"])

        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            if spell is not None:
                head = batch.select([0, 1, 3])
                batches_.append(head)
                name.update(repr((head.column(0).to_pylist(), head.column(1).to_pylist(), np.diff(offsets).tolist())).encode())
                name.update(data)
            for i, _, part, offs in blocks(data, offsets):
                starts, ends, row = token_spans(part, offs)
                cost = np.zeros(len(row), np.int64)
                if table is not None:
                    total = spelling(part, offs, table)
                    letters.append(np.round(np.diff(total[offs]), 6))
                    chars.append(np.diff(np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])[offs]))
                    cost = spelled(total, starts, row, offs) if len(starts) else cost
                if len(starts):
                    grams.append((span_hash(prefix_hash(part), starts, ends), row + i + n_rows, cost))
            n_rows, n_bytes = n_rows + batch.num_rows, n_bytes + len(data)
            if n_bytes >= BAG_BYTES:
                yield packed()
                batches_, grams, letters, chars, name, n_rows, n_bytes = [], [], [], [], hashlib.blake2b(digest_size=8), 0, 0
        if n_rows:
            yield packed()

    return docs.select("doc_id", "lang", "text", "trained").mapInArrow(lean(run), "shard long, name long, bag binary, info binary")


def _distinct(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Trigrams with their keys in order, and summed counts."""
    key = pair_key(pair_key(a, b), c)
    by = np.argsort(key)
    key = key[by]
    new = np.flatnonzero(_groups(key))
    at = by[new]
    return key[new], a[at], b[at], c[at], np.add.reduceat(n[by].astype(np.int64), new) if len(new) else np.zeros(0, np.int64)


_TOLD = "kind int, shard long, key long, n long, blob binary"


class _Told:
    """Rows of ``_TOLD``."""

    def __init__(self) -> None:
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.blobs: list[bytes | None] = []

    def add(self, kind: int, shard: np.ndarray | int, key: np.ndarray | int, n: np.ndarray | int, blobs: list[bytes] | None = None) -> None:
        size = max(np.size(shard), np.size(key), np.size(n))
        if len(np.atleast_1d(key)) and len(np.atleast_1d(shard)):
            self.rows.append(tuple(np.broadcast_to(np.asarray(x).astype(np.uint64).view(np.int64), size) for x in (kind, shard, key, n)))
            self.blobs += blobs or [None] * size

    def few(self, kind: int, n: np.ndarray) -> None:
        """How many have each count from 1 to 4."""
        self.add(kind, 0, np.arange(1, 5), np.bincount(np.minimum(n, 5), minlength=6)[1:5])

    def ends(self, at: int, shards: int, c: np.ndarray, n: np.ndarray) -> None:
        """Bigrams that end with each token: packed by ranges of known ones, rows of hashed ones."""
        c, n = _sums(c, n)
        known = c < _HASHED
        part = c[known] >> _RANGE
        for i in np.unique(part):
            self.add(7, i, 0, 0, [_pack_counts(c[known][part == i], n[known][part == i])])
        self.add(1, at, c[~known], n[~known])
        self.add(6, _place(mix64(c[~known]), shards), c[~known], 0)

    def table(self) -> pa.Table:
        columns = [np.concatenate(x) for x in zip(*self.rows)]
        return pa.table([pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:]), pa.array(self.blobs, pa.binary())], ["kind", "shard", "key", "n", "blob"])


def _pairs(blobs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a heavy token and the one after it, with a count."""
    parts = [_unpack(x.as_py(), (np.uint64, np.uint64, np.uint32)) for x in blobs]
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint32))


def tallied(trained: DataFrame, shards: int, heavy: np.ndarray, words: Broadcast) -> DataFrame:
    """Rows of ``_TOLD``: what the shards of trigrams tell of lower orders.

    Kinds 2 and 3: number (``n``) of 2- and 3-grams with count ``key`` (1 to 4).
    Kind 7: known tokens with the different bigrams that they end, packed by
    range (``shard``); kind 1: hashed tokens with theirs; kind 6: the shards
    where hashed tokens are scored alone.
    Bigrams of heavy first tokens are spread, and are summed in their pairs'
    shards.  Kind 5: how many of such a token (``key``) have count ``shard``
    (1, 2, or 3 and more), and their summed counts (0).  Kind 8: the counts in
    the pairs' shards, to score pairs; kind 9: those that a shard of trigrams needs.
    """

    def run(table: pa.Table) -> pa.Table:
        at, told = table.column("shard")[0].as_py(), _Told()
        _, _, b, c, n = _distinct(*(np.concatenate(x) for x in zip(*(_trigrams(x.as_py(), _COUNT_KINDS) for x in table.column("bag")))))
        told.few(3, n)
        # Different first tokens of each bigram.
        _, where, n = np.unique(pair_key(b, c), return_index=True, return_counts=True)
        b, c = b[where], c[where]
        spread = np.isin(b, heavy)
        told.few(2, n[~spread])
        told.ends(at, shards, c, ~spread)
        b, c, n = b[spread], c[spread], n[spread]
        by = np.lexsort((c, b))
        b, c, n = b[by], c[by], n[by]
        home = _place(pair_key(b, c), shards)
        for i in np.unique(home):
            told.add(4, i, at, 0, [_pack([b[home == i], c[home == i], n[home == i].astype(np.uint32)])])
        return told.table()

    def summed(table: pa.Table) -> pa.Table:
        at, told = table.column("shard")[0].as_py(), _Told()
        parts = [_pairs([x]) for x in table.column("blob")]
        b, c, n = (np.concatenate(x) for x in zip(*parts))
        _, where, group = np.unique(pair_key(b, c), return_index=True, return_inverse=True)
        n = np.bincount(group, n).astype(np.int64)
        cuts = np.cumsum([len(x[0]) for x in parts])[:-1]
        for origin, (x, y, _), k in zip(table.column("key"), parts, np.split(n[group], cuts)):
            told.add(9, origin.as_py(), 0, 0, [_pack([x, y, k.astype(np.uint32)])])
        b, c = b[where], c[where]
        told.add(8, at, 0, 0, [_pack([b, c, n.astype(np.uint32)])])
        told.few(2, n)
        told.ends(at, shards, c, np.ones(len(c), np.int64))
        for x in np.unique(b):
            told.add(5, np.arange(4), np.full(4, x), np.append(n[b == x].sum(), np.bincount(np.minimum(n[b == x], 3), minlength=4)[1:4]))
        return told.table()

    told = checkpoint(bags(trained, shards, heavy, words).groupBy("shard").applyInArrow(lean_group(run), _TOLD))
    if not len(heavy):
        return told
    pairs = checkpoint(told.where("kind = 4").groupBy("shard").applyInArrow(lean_group(summed), _TOLD))
    return told.where("kind <> 4").unionByName(pairs)


def _cuts(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(n > 0, np.array([0.0, *d])[np.minimum(n, 3)], 0.0)


class Table:
    """Values of keys, looked up by search in their sorted order."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray) -> None:
        by = np.argsort(keys)
        self.keys, self.values = keys[by], [v[by] for v in values]

    def get(self, keys: np.ndarray, *missing: float) -> list[np.ndarray]:
        if not len(self.keys):
            return [np.full(len(keys), m) for m in missing]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return [np.where(hit, v[at], m) for v, m in zip(self.values, missing)]


def _contexts(keys: np.ndarray, n: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts with their summed counts and what is cut off these."""
    known, group = np.unique(keys, return_inverse=True)
    return known, np.bincount(group, n, len(known)), np.bincount(group, cut, len(known))


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of tables that are checkpointed or gone; its cleaner learns of these from collected garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def log_losses(docs: DataFrame, losses: Losses) -> DataFrame:
    """``doc_id, lang, chars, letters, loss``: code points of every row and summed log-losses, by the characters alone and by the words.

    ``docs`` has ``doc_id, lang, text, trained``; the words' counts are those
    of the rows that are ``trained``.  The trigrams of these travel, packed, to
    be counted for counts of counts and lower orders; then those of all rows
    travel to be scored in their shard.
    """
    context = docs.sparkSession.sparkContext
    held = context.broadcast(losses)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), "trained")
    trained = rows.where("trained and text <> ''")
    shards = 1 + (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // SHARD_CHARS
    frequent = heavy_words(rows, shards)
    known = known_words(trained, shards, frequent)
    heavy, n_known = np.sort(known.codes(frequent)), len(known.hashes)
    heavy = heavy[heavy != _UNKNOWN]
    words = context.broadcast(known)
    told = tallied(trained, shards, heavy, words)

    def ranged(table: pa.Table) -> pa.Table:
        return pa.table({"blob": pa.array([_pack_counts(*_unpack_counts(table.column("blob")))], pa.binary())})

    ends = np.zeros(n_known, np.int64)
    for r in told.where("kind = 7").select("shard", "blob").groupBy("shard").applyInArrow(lean_group(ranged), "blob binary").collect():
        key, n = _unpack(bytes(r["blob"]), (np.uint64, np.uint32))
        ends[(np.cumsum(key, dtype=np.uint64) - _KNOWN).astype(np.int64)] = n
    single = checkpoint(told.where("kind in (1, 6)").groupBy("key").agg(F.sum("n").alias("n")).where("n > 0"))
    of_counts = {(r["kind"], r["key"]): r["n"] for r in told.where("kind in (2, 3)").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()}
    few = {r["n"]: r["k"] for r in single.where("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()}
    d1 = discounts({n: few.get(n, 0) + int((ends == n).sum()) for n in range(1, 5)})
    d2, d3 = (discounts({n: of_counts.get((order, n), 0) for n in range(1, 5)}) for order in (2, 3))
    cut = F.when(F.col("n") == 1, d1[0]).when(F.col("n") == 2, d1[1]).otherwise(d1[2])
    rare = single.agg(F.sum("n").alias("all"), F.sum(cut).alias("left")).first()
    all_ends, left_ends = int(ends.sum()) + (rare["all"] or 0), float(_cuts(ends, d1).sum()) + (rare["left"] or 0.0)
    unseen = -float(np.log(left_ends / all_ends)) if all_ends else 0.0
    costs = context.broadcast(Costs(ends.astype(np.uint32), all_ends, d1, unseen))
    backs = {(r["key"], r["shard"]): r["n"] for r in told.where("kind = 5").groupBy("key", "shard").agg(F.sum("n").alias("n")).collect()}
    far_keys = np.array(sorted({k for k, _ in backs}), dtype=np.int64)
    far_all = np.array([backs[k, 0] for k in far_keys.tolist()], dtype=float)
    far_left = np.array([sum(backs[k, i] * d2[i - 1] for i in (1, 2, 3)) for k in far_keys.tolist()], dtype=float)

    # What each shard needs of the orders that it doesn't hold.
    needs = told.where("kind in (1, 6)").select("shard", "key").distinct().join(single, "key").select("shard", F.lit(1).alias("kind"), "key", "n", F.lit(None).cast("binary").alias("blob"))
    values = needs.unionByName(told.where("kind in (8, 9)").select("shard", "kind", "key", "n", "blob"))

    def score(bag: pa.Table, value: pa.Table) -> pa.Table:
        """What seen n-grams of a shard change of each row's base, in whole millionths, so that sums don't depend on their order."""
        names, sums_, infos = [], [], []
        if not bag.num_rows:
            return pa.table({"name": pa.array([], pa.int64()), "sums": pa.array([], pa.binary()), "info": pa.array([], pa.binary())})
        alone = costs.value
        kind, key, n = (value.column(x).to_numpy() for x in ("kind", "key", "n"))
        one = kind == 1
        more = Table(key[one].view(np.uint64), n[one])
        far_b, far_c, far_n = _pairs([x for x, k in zip(value.column("blob"), kind) if k != 1])
        parts = []
        for x in bag.column("bag"):
            a, b, c, row, _, flags = _trigrams(x.as_py(), _SCORE_KINDS)
            own = np.unpackbits(flags)[row].astype(bool) & (a != _PAIR) & (a != _ALONE)
            parts.append(_distinct(a[own], b[own], c[own], own[own])[1:])
        k3, a, b, c, n3 = _distinct(*(np.concatenate(x) for x in zip(*parts)))
        del parts
        cut3 = _cuts(n3, d3)
        third, back3 = Table(k3, n3 - cut3), Table(*_contexts(pair_key(a, b), n3, cut3))
        k2, where, n2 = np.unique(pair_key(b, c), return_index=True, return_counts=True)
        b = b[where]
        plain = ~np.isin(b, heavy)
        k2, b, n2 = k2[plain], b[plain], n2[plain]
        cut2 = _cuts(n2, d2)
        seen_b, all2, left2 = _contexts(b, n2, cut2)
        second = Table(np.concatenate([k2, pair_key(far_b, far_c)]), np.concatenate([n2 - cut2, far_n - _cuts(far_n, d2)]))
        back2 = Table(np.concatenate([seen_b, far_keys.view(np.uint64)]), np.concatenate([all2, far_all]), np.concatenate([left2, far_left]))
        del a, b, c, n3, cut3, k2, where, n2, plain, cut2
        for name, x, info in zip(bag.column("name"), bag.column("bag"), bag.column("info")):
            a, b, c, row, cost, _ = _trigrams(x.as_py(), _SCORE_KINDS)
            new = _groups(a, b, c)
            at = np.cumsum(new) - 1
            a, b, c = a[new], b[new], c[new]
            p1 = alone.share(c, more)
            seen = p1 > 0
            p1 = np.where(seen, p1, 1.0)
            new_b, new_ab = _groups(b), _groups(b, a)
            in_b, in_ab = np.cumsum(new_b) - 1, np.cumsum(new_ab) - 1
            whole, rest = (v[in_b] for v in back2.get(b[new_b], 1.0, 1.0))
            p2 = second.get(pair_key(b, c), 0.0)[0] / whole + rest / whole * p1
            key_ab = pair_key(a[new_ab], b[new_ab])
            whole, rest = (v[in_ab] for v in back3.get(key_ab, 0.0, 0.0))
            p3 = p2.copy()
            found = np.flatnonzero(whole > 0)
            p3[found] = third.get(pair_key(key_ab[in_ab[found]], c[found]), 0.0)[0] / whole[found] + rest[found] / whole[found] * p2[found]
            # A pair is scored as a pair in its own shard, so here only what the token before it changes.
            spread = np.isin(b[new_b], heavy)[in_b]
            change = np.log(np.where(spread & (a != _PAIR), p2, p1) / np.where(a == _PAIR, p2, p3))[at]
            single = (a == _ALONE)[at]
            change[single] = (seen[at] * (-np.log(p1)[at] - cost / _SPELL_STEPS - unseen))[single]
            used, group = np.unique(row, return_inverse=True)
            names.append(name.as_py())
            sums_.append(_pack([np.diff(used, prepend=np.uint32(0)), np.bincount(group, np.round(change * 1e6), len(used)).astype(np.int64)]))
            infos.append(info.as_py())
        return pa.table({"name": pa.array(names, pa.int64()), "sums": pa.array(sums_, pa.binary()), "info": pa.array(infos, pa.binary())})

    def summed(table: pa.Table) -> pa.Table:
        """Rows of a bag with changes summed over its shards; bags of equal rows add up."""
        infos = [x.as_py() for x in table.column("info") if x.is_valid]
        info = pa.ipc.open_stream(zstandard.decompress(infos[0])).read_all()
        total = np.zeros(info.num_rows, np.int64)
        for x in table.column("sums"):
            used, change = _unpack(x.as_py(), (np.uint32, np.int64))
            total[np.cumsum(used, dtype=np.int64)] += change
        loss = info.column("base").to_numpy() + total / len(infos) / 1e6
        out = pa.table({"doc_id": info.column("doc_id"), "lang": info.column("lang"), "chars": info.column("chars"), "letters": info.column("letters"), "loss": pa.array(loss)})
        return pa.concat_tables([out] * len(infos))

    release(docs.sparkSession)
    scored = bags(rows, shards, heavy, words, held, costs).groupBy("shard").cogroup(values.groupBy("shard")).applyInArrow(score, "name long, sums binary, info binary")
    out = scored.groupBy("name").applyInArrow(lean_group(summed), "doc_id long, lang string, chars long, letters double, loss double")
    return out.withColumn("loss", F.round("loss", 6))


def drawn_and_limit(known: DataFrame, loss: str, quantile: float) -> tuple[Column, Column] | None:
    """A row's mean log-loss, drawn to the trusted mean, and the limit of its language; none without trusted rows."""
    group = F.coalesce("lang", F.lit("\x00"))
    # Means and then histograms per language; "*" stands for all.
    spread = known.withColumn("g", F.explode(F.array(group, F.lit("*"))))
    means = {r["g"]: r["m"] for r in spread.groupBy("g").agg((F.sum(F.round(loss, 3).cast("decimal(28,3)")).cast("double") / F.sum("chars")).alias("m")).collect()}
    if not means:
        return None
    mean_of = F.create_map(*[x for k, v in means.items() for x in (F.lit(k), F.lit(v))])
    prior = F.coalesce(F.try_element_at(mean_of, F.coalesce("lang", F.lit("\x00"))), F.lit(means["*"]))
    drawn = (F.col(loss) + PRIOR_CHARS * prior) / (F.col("chars") + PRIOR_CHARS)
    bins = known.withColumn("bin", F.ceil(drawn / BIN)).withColumn("g", F.explode(F.array(group, F.lit("*")))).groupBy("g", "bin").agg(F.count("*").alias("n")).collect()
    limits: dict[str, float] = {}
    few = set()
    for g in means:
        own = sorted((r["bin"], r["n"]) for r in bins if r["g"] == g)
        need, seen = quantile * sum(n for _, n in own), 0
        if sum(n for _, n in own) < MIN_CALIBRATION:
            few.add(g)
        for b, n in own:
            seen += n
            if seen >= need:
                limits[g] = b * BIN
                break
    for g in few:
        limits[g] = max(limits[g], limits["*"])
    limit_of = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])
    limit = F.coalesce(F.try_element_at(limit_of, F.coalesce("lang", F.lit("\x00"))), F.lit(limits["*"]))
    return drawn, limit


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``doc_id, lang, n_chars, perplexity, threshold, keep`` for every row."""
    ids = trusted_ids(labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.join(ids, "doc_id", "left").select("doc_id", "lang", "text", F.coalesce(~F.col("calibrates") & F.col("text").isNotNull(), F.lit(False)).alias("trained"))
    losses = train(rows.where("trained").select("text"))
    scored = checkpoint(log_losses(rows, losses))
    known = scored.where("chars > 0").join(ids.where("calibrates"), "doc_id", "left_semi")
    words, letters = drawn_and_limit(known, "loss", quantile), drawn_and_limit(known, "letters", quantile)
    if words is None or letters is None:
        return scored.select("doc_id", "lang", F.col("chars").alias("n_chars"), F.when(F.col("chars") > 0, F.lit(float(ALPHABET))).alias("perplexity"), F.lit(float(ALPHABET)).alias("threshold"), (F.col("chars") > 0).alias("keep"))
    usual = (words[0] <= words[1]) & (letters[0] <= letters[1])
    return scored.select("doc_id", "lang", F.col("chars").alias("n_chars"), F.when(F.col("chars") > 0, F.round(F.exp(F.col("loss") / F.col("chars")), 6)).alias("perplexity"), F.round(F.exp(words[1]), 6).alias("threshold"), ((F.col("chars") > 0) & usual).alias("keep"))
