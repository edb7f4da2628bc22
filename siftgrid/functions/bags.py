"""Term bags of whole corpora, in Arrow batches.

The Column expressions of :mod:`tokens` serve questions and other short texts.
Over a corpus a regular expression per 4-gram costs most of the time, so here a
batch is folded and cut into words as one buffer, and what is made of a word is
made once per distinct word of the batch; only texts beyond Latin are
normalized by the JVM.  Both ways give the same terms (a test).
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import _folding, normalize
from .tokens import GRAM, NUMBER_WORDS, STOPWORDS

#: Bytes of text, or words, that are worked on at once.
BATCH_BYTES, BATCH_WORDS = 4 << 20, 1 << 19
#: Words longer than this are cut into n-grams one by one.
LONG_WORD = 64


def spaced(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, plain, done``: Latin texts as they are, all others normalized and reduced to letters, numbers and blanks.

    Latin letters (below U+0250) are folded by :func:`cut`, to what the JVM makes of them.
    """
    rows = rows.select(key, F.coalesce(F.col(text), F.lit("")).alias("plain")).withColumn("done", F.col("plain").rlike(r"[^\x00-\u024F]"))
    return rows.withColumn("plain", F.when(F.col("done"), F.regexp_replace(normalize(F.col("plain")), r"[^\p{L}\p{N}]+", " ")).otherwise(F.col("plain")))


@lru_cache(maxsize=1)
def _latin() -> dict[int, str | None]:
    """What becomes of lower-cased Latin characters beyond ASCII: folded, or a blank if no letter or number."""
    source, target, gone, longer = _folding()
    table: dict = dict(zip(source, target)) | dict.fromkeys(gone, "") | longer
    own = [*map(chr, range(0x80, 0x250)), "\u0307", "\u2c65", "\u2c66"]
    return {ord(c): "".join(x if x.isascii() or unicodedata.category(x)[0] in "LN" else "" if unicodedata.category(x) == "Mn" else " " for x in table.get(c, c)) for c in own}


def _separators(ascii_only: bool) -> np.ndarray:
    """Bytes, all but letters, digits and (unless ``ascii_only``) bytes beyond ASCII turned to blanks."""
    kept = np.full(256, ord(" "), dtype=np.uint8)
    own = [b for b in range(256) if (b < 128 and chr(b).isalnum()) or (b > 127 and not ascii_only)]
    kept[own] = own
    return kept


def _lower(separators: np.ndarray) -> np.ndarray:
    return np.array([ord(chr(b).lower()) if b < 128 else b for b in separators], dtype=np.uint8)


_SEPARATORS = {x: _separators(x) for x in (True, False)}
_FOLDED = {x: _lower(y) for x, y in _SEPARATORS.items()}


@dataclass
class Words:
    """Words of some texts in order: ``codes`` into ``words``, and which text each is of."""

    words: pa.Array
    codes: np.ndarray
    texts: np.ndarray
    n: int

    @property
    def sizes(self) -> np.ndarray:
        return pc.utf8_length(self.words).to_numpy()

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, word and number of each distinct word of a text, by text."""
        v = max(1, len(self.words))
        keys, n = np.unique(self.texts * v + self.codes, return_counts=True)
        return keys // v, keys % v, n

    def joined(self, texts: np.ndarray, codes: np.ndarray) -> pa.Array:
        """Per text the given words, which come by text, joined by blanks."""
        return join(self.words, self.n, texts, codes)


def join(words: pa.Array, n: int, texts: np.ndarray, codes: np.ndarray) -> pa.Array:
    offsets = np.searchsorted(texts, np.arange(n + 1)).astype(np.int64)
    lists = pa.LargeListArray.from_arrays(pa.array(offsets), words.take(pa.array(codes)).cast(pa.large_string()))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def cut(texts: pa.Array, done: pa.Array, ascii_only: bool = False) -> Words:
    """The words of :func:`spaced` texts."""
    done = done.to_numpy(zero_copy_only=False)
    rest = ~done & (pc.binary_length(texts).to_numpy() != pc.utf8_length(texts).to_numpy())
    if rest.any():
        table = _latin()
        texts = pa.array([t.lower().translate(table) if latin else t for t, latin in zip(texts.to_pylist(), rest)], pa.large_string())
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    if done.any():
        # What the JVM has normalized keeps its case: capitals that come out of symbols stay.
        clean = np.where(np.repeat(done, np.diff(at)), _SEPARATORS[ascii_only][raw], _FOLDED[ascii_only][raw])
    else:
        clean = _FOLDED[ascii_only][raw]
    lists = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at), pa.py_buffer(clean)))
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten()
    full = pc.not_equal(flat, "")
    coded = flat.filter(full).dictionary_encode()
    return Words(coded.dictionary.cast(pa.string()), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), owner[full.to_numpy(zero_copy_only=False)], len(texts))


def grams(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The 4-grams of words, each as often as its word holds it, and which word each is of."""
    sizes = pc.utf8_length(words).to_numpy()
    order = np.argsort(-sizes, kind="stable")
    parts, owners = [], []
    for at in range(max(0, min(LONG_WORD, int(sizes.max(initial=0))) - GRAM + 1)):
        own = order[: np.searchsorted(-sizes[order], -(at + GRAM), side="right")]
        parts.append(pc.utf8_slice_codeunits(words.take(pa.array(own)), at, at + GRAM))
        owners.append(own)
    for i in np.flatnonzero(sizes > LONG_WORD):
        word = words[int(i)].as_py()
        rest = [word[k : k + GRAM] for k in range(LONG_WORD - GRAM + 1, len(word) - GRAM + 1)]
        parts.append(pa.array(rest, pa.string()))
        owners.append(np.full(len(rest), i))
    if not parts:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    return pa.concat_arrays(parts), np.concatenate(owners).astype(np.int64)


def by_owner(owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` owners where its entries start, and the entries by owner."""
    return np.searchsorted(owners, np.arange(n + 1), sorter=(order := np.argsort(owners, kind="stable"))), order


def spread_out(starts: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All entries of the picked owners: which pick each is of, and its place."""
    n = starts[picked + 1] - starts[picked]
    pick = np.repeat(np.arange(len(picked)), n)
    return pick, np.arange(len(pick)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[picked], n)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's numbers."""
    if not len(keys):
        return keys, n
    # Sorted as one number where both fit, which is several times faster than an order.
    bits = int(n.max()).bit_length()
    if int(keys.max()).bit_length() + bits < 63:
        both = np.sort(keys << bits | n)
        keys, n = both >> bits, both & ((1 << bits) - 1)
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def bag(words: Words, least: int = 1, with_grams: bool = True, names: dict[str, str] | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted terms, and text, term and number of each posting by text and term.

    Words of at least ``least`` characters, their ``char:`` 4-grams and the
    names of words that ``names`` has.
    """
    texts, codes, n = words.counted()
    kept = words.sizes[codes] >= least
    texts, codes, n = texts[kept], codes[kept], n[kept]
    made, owners = [words.words], [np.arange(len(words.words))]
    if with_grams:
        own, owner = grams(words.words)
        made.append(pc.binary_join_element_wise(pa.scalar("char:"), own, ""))
        owners.append(owner)
    if names:
        spelled = [(i, names[w]) for w in names if (i := pc.index(words.words, w).as_py()) >= 0]
        made.append(pa.array([w for _, w in spelled], pa.string()))
        owners.append(np.array([i for i, _ in spelled], dtype=np.int64))
    coded = pa.concat_arrays(made).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    terms = rank[coded.indices.to_numpy(zero_copy_only=False)]
    starts, entries = by_owner(np.concatenate(owners), len(words.words))
    pick, place = spread_out(starts, codes)
    v = max(1, len(order))
    keys, total = summed(texts[pick] * v + terms[entries[place]], n[pick])
    return coded.dictionary.take(pa.array(order)), keys // v, keys % v, total


def _md5(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.md5(t.as_buffer()).hexdigest() for t in texts], pa.string())


def sliced(batches: Iterator[pa.RecordBatch], column: int, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut where a column of texts or lists comes to ``size`` bytes or members."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)) if pa.types.is_string(batch.column(column).type) or pa.types.is_large_string(batch.column(column).type) else pc.list_value_length(batch.column(column))
        ends = np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def digests(docs: DataFrame, key: str, text: str, least: int = 1, with_grams: bool = True, numbers: bool = False, ascii_only: bool = False) -> DataFrame:
    """``key, n_terms, n_distinct, terms``: size, distinct terms and MD5 of the sorted bag of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            terms, texts, codes, n = bag(cut(batch.column(1), batch.column(2), ascii_only), least, with_grams, NUMBER_WORDS if numbers else None)
            size = np.bincount(texts, weights=n, minlength=batch.num_rows).astype(np.int64)
            distinct = np.bincount(texts, minlength=batch.num_rows)
            digest = _md5(join(terms, batch.num_rows, np.repeat(texts, n), np.repeat(codes, n)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(distinct), digest], [key, "n_terms", "n_distinct", "terms"])

    return spaced(docs, key, text).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, n_terms long, n_distinct long, terms string")


def content_words(words: pa.Array, use: str = "mining") -> np.ndarray:
    """Which words are content terms: three and more characters, no number and no stopword."""
    told = pc.and_(pc.greater_equal(pc.utf8_length(words), 3), pc.invert(pc.match_substring_regex(words, "^[0-9]+$")))
    return pc.and_not(told, pc.is_in(words, pa.array(STOPWORDS[use]))).to_numpy(zero_copy_only=False)


def content_digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, used_for, n_distinct, terms``: distinct content terms, and MD5 of all in order, for every stopword list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            words = cut(batch.column(1), batch.column(2))
            own, codes, _ = words.counted()
            for use in STOPWORDS:
                told = content_words(words.words, use)
                distinct = np.bincount(own[told[codes]], minlength=batch.num_rows)
                kept = told[words.codes]
                digest = _md5(words.joined(words.texts[kept], words.codes[kept]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([use] * batch.num_rows), pa.array(distinct), digest], [key, "used_for", "n_distinct", "terms"])

    return spaced(docs, key, text).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, used_for string, n_distinct long, terms string")


def bags(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc_id, words, counts, dl``: the distinct words of at least two characters, and how many index terms they make."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            words = cut(batch.column(1), batch.column(2))
            texts, codes, n = words.counted()
            kept = words.sizes[codes] >= 2
            texts, codes, n = texts[kept], codes[kept], n[kept]
            terms = 1 + np.maximum(0, words.sizes - GRAM + 1)
            length = np.bincount(texts, weights=n * terms[codes], minlength=batch.num_rows).astype(np.int64)
            offsets = pa.array(np.searchsorted(texts, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (words.words.take(pa.array(codes)), pa.array(n.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array(length)], ["doc_id", "words", "counts", "dl"])

    return spaced(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)[key]}, words array<string>, counts array<int>, dl long")


def of_bags(batch: pa.RecordBatch, words: int, counts: int) -> tuple[Words, np.ndarray]:
    """The words of a batch of :func:`bags`, and the number of each."""
    sizes = pc.list_value_length(batch.column(words)).to_numpy(zero_copy_only=False)
    coded = batch.column(words).flatten().dictionary_encode()
    owner = np.repeat(np.arange(batch.num_rows, dtype=np.int64), sizes)
    return Words(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), owner, batch.num_rows), batch.column(counts).flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def frequencies(kept: DataFrame) -> DataFrame:
    """``term, df`` of all index terms of :func:`bags`: counted in each batch, then added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0, BATCH_WORDS):
            words, _ = of_bags(batch, 0, 1)
            # A word is in a bag once; its n-grams may come from other words too.
            yield pa.RecordBatch.from_arrays([words.words, pa.array(np.bincount(words.codes, minlength=len(words.words)))], ["term", "df"])
            own, owner = grams(words.words)
            coded = own.dictionary_encode()
            starts, entries = by_owner(owner, len(words.words))
            pick, place = spread_out(starts, words.codes)
            size = max(1, len(coded.dictionary))
            keys = np.sort(words.texts[pick] * size + coded.indices.to_numpy(zero_copy_only=False)[entries[place]])
            df = np.bincount(keys[np.concatenate([[True], keys[1:] != keys[:-1]])] % size if len(keys) else keys, minlength=len(coded.dictionary))
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(pa.scalar("char:"), coded.dictionary, ""), pa.array(df)], ["term", "df"])

    return kept.select("words", "counts").mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def postings(kept: DataFrame) -> DataFrame:
    """``term, doc_id, tf`` of all index terms of :func:`bags`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0, BATCH_WORDS):
            words, n = of_bags(batch, 0, 1)
            words = Words(words.words, np.repeat(words.codes, n), np.repeat(words.texts, n), words.n)
            terms, texts, codes, tf = bag(words, 2)
            yield pa.RecordBatch.from_arrays([terms.take(pa.array(codes)), batch.column(2).take(pa.array(texts)), pa.array(tf)], ["term", "doc_id", "tf"])

    return kept.select("words", "counts", "doc_id").mapInArrow(run, f"term string, doc_id {dict(kept.dtypes)['doc_id']}, tf long")
