"""Benchmark decontamination with a generalised suffix automaton (operator 3).

The automaton holds every run of words of every benchmark item.  Document
words are streamed through it, tracking the longest run of item words that
ends at each word; a word is *hit* if it lies in a run of at least ``window``
words of one item (or in a whole item that is shorter than that).

Before the automaton runs, a block of documents is scanned vectorised: word
hashes are looked up among the item words, neighbouring pairs among the item
pairs, and only stretches whose pairs all occur in items are streamed, with
their real words compared.  No text is skipped: a run of item words is always
inside such a stretch.

Items are cut into shards of at most ``SHARD_WORDS`` words, each with its own
automaton, so that what is broadcast has a fixed bound; documents are scanned
once per shard and the spans are united.

Defined results: null texts have no words; null item ids are ignored; rows of
equal item id count as one id, each with its own windows; without items no
word is hit.  Repeated document rows are reported once per row if there is one
shard, and by (doc_id, text) otherwise they are told apart by a row key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, blocks, id_and_text, lean, mix64, prefix_hash, span_hash, text_buffers, word_spans

WINDOW = 8
SHARD_WORDS = 100_000
MIN_ITEMS = 2
#: Filter pass: documents lose matched spans; one that is hit beyond this share goes.
MAX_COVERAGE = 0.8


def split_words(text: str | None) -> list[bytes]:
    data = LOWER[np.frombuffer((text or "").encode("utf-8"), dtype=np.uint8)]
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers, one item after another."""

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _grow(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _branch(self, state: int, symbol: int, target: int) -> int:
        """Give the runs of ``target`` that ``state`` can prolong a state of their own."""
        copy = self._grow(self.length[state] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.step[state].get(symbol) == target:
            self.step[state][symbol] = copy
            state = self.link[state]
        return copy

    def extend(self, last: int, symbol: int) -> int:
        target = self.step[last].get(symbol)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._branch(last, symbol, target)
        new = self._grow(self.length[last] + 1, {}, -1)
        state = last
        while state >= 0 and symbol not in self.step[state]:
            self.step[state][symbol] = new
            state = self.link[state]
        if state < 0:
            self.link[new] = 0
        else:
            target = self.step[state][symbol]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._branch(state, symbol, target)
        return new

    def at_length(self, state: int, length: int) -> int:
        """The state of the last ``length`` words of a run that ends in ``state``."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state


class ItemIndex:
    """One shard of items: automaton, windows and the lookup tables of the scan."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.number: dict[bytes, int] = {}
        self.automaton = SuffixAutomaton()
        coded = [(key, [self.number.setdefault(w, len(self.number)) for w in words]) for key, words in items if words]
        pairs: set[int] = set()
        for _, words in coded:
            state = 0
            for w in words:
                state = self.automaton.extend(state, w)
        for _, words in coded:
            pairs.update(a << 32 | b for a, b in zip(words, words[1:]))
        self.owners: dict[tuple[int, int], set[str]] = {}
        for key, words in coded:
            size = min(window, len(words))
            for i in range(len(words) - size + 1):
                state = 0
                for w in words[i : i + size]:
                    state = self.automaton.step[state][w]
                self.owners.setdefault((self.automaton.at_length(state, size), size), set()).add(key)
        self.sizes = sorted({size for _, size in self.owners})
        joined = b"".join(self.number)
        ends = np.cumsum([len(w) for w in self.number]) if self.number else np.zeros(0, np.int64)
        data = np.frombuffer(joined, dtype=np.uint8)
        hashes = span_hash(prefix_hash(data), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if len(ends) else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.of_hash = hashes[order], np.arange(len(order))[order]
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers, -1 for words that no item has."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(44)).astype(np.int64)])
        if len(maybe) and len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            same = self.hashes[at] == hashes[maybe]
            out[maybe[same]] = self.of_hash[at[same]]
        return out

    def stretches(self, number: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one-past-last word of each stretch that may hold a window."""
        if not self.sizes:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = number >= 0
        joined = np.zeros(len(number) + 1, dtype=bool)  # joined[i]: word i-1 and word i may be neighbours in an item
        near = np.flatnonzero(known[:-1] & known[1:] & (row[:-1] == row[1:]))
        if len(near) and len(self.pairs):
            code = number[near] << 32 | number[near + 1]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            joined[near[self.pairs[at] == code] + 1] = True
        first = np.flatnonzero(known & ~joined[:-1])
        last = np.flatnonzero(known & ~joined[1:]) + 1
        long = last - first >= self.sizes[0]
        return first[long], last[long]

    def runs(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit runs (from, to) of a stretch and the items whose windows occur."""
        automaton, state, length = self.automaton, 0, 0
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        for i, word in enumerate(words):
            w = self.number.get(word, -1)
            while state and w not in automaton.step[state]:
                state = automaton.link[state]
                length = automaton.length[state]
            if w in automaton.step[state]:
                state, length = automaton.step[state][w], length + 1
            for size in self.sizes:
                if size > length:
                    break
                owners = self.owners.get((automaton.at_length(state, size), size))
                if owners:
                    items |= owners
                    if found and found[-1][1] >= i + 1 - size:
                        found[-1] = (min(found[-1][0], i + 1 - size), i + 1)
                    else:
                        found.append((i + 1 - size, i + 1))
        return found, items


def item_shards(items: DataFrame, window: int, key: str, text: str) -> list:
    """Broadcast indexes of at most ``SHARD_WORDS`` words each (one item at least)."""
    context = items.sparkSession.sparkContext
    shards, held, size = [], [], 0
    rows = items.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t")).where("k is not null and t is not null").distinct()
    for row in rows.toLocalIterator():
        words = split_words(row["t"])
        if held and size + len(words) > SHARD_WORDS:
            shards.append(context.broadcast(ItemIndex(held, window)))
            held, size = [], 0
        held.append((row["k"], words))
        size += len(words)
    if held or not shards:
        shards.append(context.broadcast(ItemIndex(held, window)))
    return shards


def _scan(batch: pa.RecordBatch, text: int, index: ItemIndex) -> Iterator[tuple[np.ndarray, dict[int, tuple[list[tuple[int, int, int, int]], set[str]]]]]:
    """For each block: words per row, and for rows with hits the hit runs and items.

    A run is (first word, end word, first byte, end byte), counted in its row.
    """
    data, offsets = text_buffers(batch.column(text))
    for _, _, part, offs in blocks(data, offsets):
        low = LOWER[part]
        starts, ends, row = word_spans(part, offs)
        counts = np.bincount(row, minlength=len(offs) - 1)
        heads = np.cumsum(counts) - counts
        hits: dict[int, tuple[list, set[str]]] = {}
        number = index.numbers(span_hash(prefix_hash(low), starts, ends)) if len(starts) else np.zeros(0, np.int64)
        for a, b in zip(*(x.tolist() for x in index.stretches(number, row))):
            words = [low[s:e].tobytes() for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())]
            found, items = index.runs(words)
            if found:
                r = int(row[a])
                spans, owners = hits.setdefault(r, ([], set()))
                spans += [(a + x - int(heads[r]), a + y - int(heads[r]), int(starts[a + x] - offs[r]), int(ends[a + y - 1] - offs[r])) for x, y in found]
                owners |= items
        yield counts, hits


def _united(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    out: list[tuple[int, int, int, int]] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            if s[1] > out[-1][1]:
                out[-1] = (out[-1][0], s[1], out[-1][2], s[3])
        else:
            out.append(s)
    return out


_MATCH = "n_words long, spans array<struct<first:int,end:int,first_byte:int,end_byte:int>>, items array<string>"
_SPANS = pa.list_(pa.struct([(n, pa.int32()) for n in ("first", "end", "first_byte", "end_byte")]))


def match_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, n_words, spans, items`` per document row.

    ``spans`` are the maximal hit runs in words and in UTF-8 bytes; ``items``
    the distinct ids, as sorted strings, of items with a window in the text.
    """
    shards = item_shards(items, window, item_key, item_text)

    def scan(shard):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words, spans, owners = [], [], []
                for counts, hits in _scan(batch, 1, shard.value):
                    words.append(counts)
                    for r in range(len(counts)):
                        s, o = hits.get(r, ((), ()))
                        spans.append([dict(zip(("first", "end", "first_byte", "end_byte"), x)) for x in _united(list(s))])
                        owners.append(sorted(o))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(words) if words else [], pa.int64()), pa.array(spans, _SPANS), pa.array(owners, pa.list_(pa.string()))], ["doc_id", "n_words", "spans", "items"])

        return run

    frame = id_and_text(docs)
    if len(shards) == 1:
        return frame.mapInArrow(lean(scan(shards[0])), f"doc_id long, {_MATCH}")
    # Several shards: unite what each found, per row; equal rows have equal results.
    parts = None
    keyed = frame.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    for shard in shards:
        one = keyed.mapInArrow(lean(_with_key(scan(shard))), f"doc_id long, key string, {_MATCH}")
        parts = one if parts is None else parts.unionByName(one)

    def unite(runs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs:
            spans = [[dict(zip(("first", "end", "first_byte", "end_byte"), x)) for x in _united([tuple(s.values()) for s in row])] for row in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(spans, _SPANS), batch.column(4)], ["doc_id", "n_words", "spans", "items"])

    merged = parts.groupBy("doc_id", "key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), (F.count("*") / len(shards)).cast("int").alias("copies"))
    merged = merged.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")
    return merged.mapInArrow(lean(unite), f"doc_id long, {_MATCH}")


def _with_key(run):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in run(iter([batch])):
                yield pa.RecordBatch.from_arrays([out.column(0), batch.column(2), *out.columns[1:]], ["doc_id", "key", *out.schema.names[1:]])

    return keyed


def digest(matches: DataFrame, min_items: int = MIN_ITEMS) -> DataFrame:
    """The digest columns of a match result."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["first"]).cast("long"))
    n_items = F.size("items").cast("long")
    return matches.select("doc_id", "n_words", hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_items >= min_items).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents without benchmark passages; columns and other texts stay.

    Hit runs are cut out; where text remains on both sides a blank joins them.
    A row whose hit words exceed ``max_coverage`` of its words goes.  ``n_chars``,
    if there is such a column, is counted anew for changed texts.
    """
    shards = item_shards(items, window, item_key, item_text)
    schema = docs.schema
    at_text = docs.columns.index("text")
    at_size = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans: dict[int, list] = {}
            words: list[np.ndarray] = []
            for k, shard in enumerate(shards):
                base = 0
                for counts, hits in _scan(batch, at_text, shard.value):
                    for r, (s, _) in hits.items():
                        spans.setdefault(base + r, []).extend(s)
                    if not k:
                        words.append(counts)
                    base += len(counts)
            if not spans:
                yield batch
                continue
            n_words = np.concatenate(words)
            texts = batch.column(at_text).to_pylist()
            sizes = batch.column(at_size).to_pylist() if at_size >= 0 else []
            keep = np.ones(batch.num_rows, dtype=bool)
            for r, found in spans.items():
                found = _united(found)
                if sum(b - a for a, b, _, _ in found) > max_coverage * n_words[r]:
                    keep[r] = False
                    continue
                raw, rest, at = texts[r].encode("utf-8"), [], 0
                for _, _, a, b in found:
                    rest.append(raw[at:a].strip())
                    at = b
                rest.append(raw[at:].strip())
                texts[r] = b" ".join(x for x in rest if x).decode("utf-8")
                if at_size >= 0:
                    sizes[r] = len(texts[r])
            columns = list(batch.columns)
            columns[at_text] = pa.array(texts, batch.schema.field(at_text).type)
            if at_size >= 0:
                columns[at_size] = pa.array(sizes, batch.schema.field(at_size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))

    return docs.mapInArrow(lean(run), schema)


def sha_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


ORACLE = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
sized AS (SELECT item, ws, least(8, len(ws)) AS size FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item, size, array_to_string(ws[i:i + size - 1], ' ') AS gram
        FROM (SELECT item, ws, size, unnest(range(1, CAST(len(ws) - size + 2 AS BIGINT))) AS i FROM sized)),
sizes AS (SELECT DISTINCT size FROM sized),
pos AS (SELECT doc_id, ws, unnest(range(1, CAST(len(ws) + 1 AS BIGINT))) AS i FROM w),
grams AS (SELECT doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') AS gram
          FROM pos, sizes WHERE i + size - 1 <= len(ws)),
found AS (SELECT g.doc_id, g.i, g.size, win.item FROM grams g JOIN win ON g.size = win.size AND g.gram = win.gram),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(own.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(own.items, '')) AS items_sha256, coalesce(own.n, 0) >= 2 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""
