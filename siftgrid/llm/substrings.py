"""Exact substring deduplication over a sparse suffix array (operator 8).

Texts are UTF-8 bytes.  A string of ``LENGTH`` bytes that also starts earlier
is a repeat, and all bytes under repeats are removed.

Not every suffix is sorted.  Each window of ``LENGTH`` bytes names one anchor:
its ``TOKEN``-byte token of least hash.  Equal windows name the same anchor at
the same place, so it is enough to bring together suffixes that begin at
anchors (one in about 35).  Neighbouring windows with one anchor form a
segment; a segment is known by its anchor's token and a hash of its bytes.

1. Sampled splitters range-partition the anchored suffixes by their leading
   bytes (then by segment, so that a hot token spreads over buckets).  Every
   task first drops segments that it has already seen earlier itself, so a
   segment reaches a bucket once per task at most, however often it occurs.
2. A bucket sorts by multikey quicksort and keeps the earliest of each
   segment.  If its token has no other segment anywhere, the windows of the
   earliest one are originals and all others are repeats.  Otherwise - also
   for every token on a splitter, where the comparison crosses the boundary -
   the windows of the earliest segments are compared one by one.
3. For that, segments with their bytes meet by token; tokens with more than
   ``HOT`` segments, and those on splitters, meet by window instead, so no
   group grows with the input.
4. Originals go back to their documents; every other window is a repeat.

Records travel as compressed column blobs, one per task and bucket.

Defined results: a null or empty text has no bytes; texts under ``LENGTH``
bytes lose nothing; null ids come last in the order; rows that share an id
take the same place in the order, so a window stays in each of them if it is
first there in one of them at the same start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, checkpoint, id_and_text, lean, lean_group, mix64, prefix_hash, span_hash, text_buffers

LENGTH = 100
TOKEN = 24
HOT = 512
#: Anchors that a task gathers before it sends them off; documents that give the splitters.
CHUNK_BYTES = 24 << 20
CHUNK_ANCHORS, SAMPLE_DOCUMENTS, SAMPLE_PER_DOCUMENT = 400_000, 4_000, 16
#: Text bytes behind one bucket of anchors, and in one part of documents; least number of either.
BUCKET_BYTES, PART_BYTES, LEAST_BUCKETS = 8 << 20, 4 << 20, 256
PIECE = 8 << 20
NULL_ID = np.iinfo(np.int64).max

_POSITION = np.uint64((1 << 24) - 1)
AMBIGUOUS, IS_HOT = 0x100, 0x200


# ---- anchors ---------------------------------------------------------------


def anchored(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of a block: first window, last window, anchor; and prefix hashes.

    Windows never cross a row.
    """
    n, span = len(data), LENGTH - TOKEN + 1
    prefix = prefix_hash(data)
    none = np.zeros(0, dtype=np.int64)
    if n < LENGTH:
        return none, none, none, prefix
    at = np.arange(n - TOKEN + 1)
    least = (span_hash(prefix, at, at + TOKEN) & ~_POSITION) | at.astype(np.uint64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: width - span], least[span - width :])
    anchor = (least & _POSITION).astype(np.int64)
    inside = np.zeros(n + 1, dtype=np.int32)
    sizes = np.diff(offsets)
    long = sizes >= LENGTH
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - LENGTH + 1, -1)
    start = np.flatnonzero(np.cumsum(inside)[: n - LENGTH + 1] > 0)
    if not len(start):
        return none, none, none, prefix
    own = anchor[start]
    head = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)]))
    return start[head], start[np.append(head[1:], len(start)) - 1], own[head], prefix


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks as (bytes, row bounds, row numbers, base of each row); very long rows in overlapping pieces."""
    for i, j, part, offs in blocks(data, offsets):
        if len(part) <= 2 * PIECE:
            yield part, offs, np.arange(i, j), np.zeros(j - i, dtype=np.int64)
            continue
        for a in range(0, len(part) - LENGTH + 1, PIECE):
            cut = part[a : a + PIECE + LENGTH - 1]
            yield cut, np.array([0, len(cut)]), np.array([i]), np.array([a])


def segments(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
    """Anchored segments of rows, in columns."""
    for part, offs, rows, base in pieces(data, offsets):
        first, last, anchor, prefix = anchored(part, offs)
        if not len(first):
            continue
        row = np.searchsorted(offs, first, "right") - 1
        token = span_hash(prefix, anchor, anchor + TOKEN)
        lead = np.zeros(len(anchor), dtype=np.uint64)
        for k in range(8):
            lead = lead << np.uint64(8) | part[anchor + k].astype(np.uint64)
        bytes_hash = span_hash(prefix, first, last + LENGTH) ^ mix64((anchor - first).astype(np.uint64) + np.uint64(1))
        yield {"lead": lead, "token": token, "segment": bytes_hash, "doc": ids[rows[row]], "start": first - offs[row] + base[row], "n": (last - first + 1).astype(np.uint16), "part": part, "first": first, "last": last, "prefix": prefix}


def multikey_order(keys: list[np.ndarray], small: int = 1 << 14) -> np.ndarray:
    """Order of rows by several keys: three-way partition by one key at a time.

    Rows equal to the pivot go on with the next key; runs of ``small`` rows are
    finished by a plain sort of the keys that are left.
    """
    out = np.arange(len(keys[0]))
    stack = [(0, len(out), 0)]
    while stack:
        lo, hi, k = stack.pop()
        rows = out[lo:hi]
        if hi - lo <= small:
            out[lo:hi] = rows[np.lexsort([key[rows] for key in reversed(keys[k:])])]
            continue
        values = keys[k][rows]
        pivot = np.partition(values[:: max(1, len(values) // 1023)], 511 if len(values) >= 1024 else len(values) // 2)[511 if len(values) >= 1024 else len(values) // 2]
        less, more = values < pivot, values > pivot
        same = ~(less | more)
        a, b = lo + int(less.sum()), hi - int(more.sum())
        out[lo:hi] = np.concatenate([rows[less], rows[same], rows[more]])
        stack += [(lo, a, k), (b, hi, k)]
        if k + 1 < len(keys):
            stack.append((a, b, k + 1))
    return out


# ---- blobs -----------------------------------------------------------------


def pack(columns: list[tuple[np.ndarray, bool]], tail: bytes = b"") -> bytes:
    """Columns (with a flag: as differences) and a tail of bytes, compressed."""
    raw = [np.int64(len(columns[0][0])).tobytes()]
    for values, rising in columns:
        raw.append((np.diff(values, prepend=values.dtype.type(0)) if rising else values).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join([*raw, tail]))


def unpack(blob: bytes, kinds: list[tuple[type, bool]]) -> tuple[list[np.ndarray], np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for kind, rising in kinds:
        values = np.frombuffer(raw, kind, n, at)
        at += values.nbytes
        out.append(np.cumsum(values, dtype=kind) if rising else values)
    return out, np.frombuffer(raw, np.uint8, offset=at) if at < len(raw) else np.zeros(0, np.uint8)


ANCHORS = [(np.uint32, False), (np.uint64, False), (np.int64, True), (np.int64, True), (np.uint16, False)]
MARKS = [(np.int64, True), (np.int64, True), (np.uint16, False)]
DOCS = [(np.int64, False), (np.int64, False), (np.uint8, False)]
BYTES = [(np.uint64, False), (np.int64, True), (np.int64, True), (np.uint16, False)]
WINDOWS = [(np.uint64, False), (np.uint64, False), (np.int64, True), (np.int64, True)]
RUNS = [(np.int64, True), (np.int64, True), (np.int64, False)]


def by_group(group: np.ndarray, *then: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers per group, ordered by the further keys."""
    order = np.lexsort([*reversed(then), group])
    cuts = np.flatnonzero(np.diff(group[order], prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(order))):
        yield int(group[order[a]]), order[a:b]


def part_of(doc: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(doc.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    groups, kinds, blobs = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["g", "kind", "blob"])


_BLOBS = "g long, kind int, blob binary"


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


# ---- steps -----------------------------------------------------------------


def splitters(docs: DataFrame, rows: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(lead, segment) bounds of the buckets from sampled documents, sorted."""
    share = int((1 << 20) * min(1.0, SAMPLE_DOCUMENTS / max(1, rows))) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for s in segments(data, offsets, _ids(batch)):
                few = [r[np.argsort(s["segment"][r])[:SAMPLE_PER_DOCUMENT]] for _, r in by_group(s["doc"])]
                few = np.concatenate(few)
                yield pa.RecordBatch.from_arrays([pa.array(s["lead"][few].view(np.int64)), pa.array(s["segment"][few].view(np.int64))], ["lead", "segment"])

    found = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share).mapInArrow(lean(run), "lead long, segment long").distinct().orderBy(F.xxhash64("lead", "segment")).limit(SAMPLE_DOCUMENTS * SAMPLE_PER_DOCUMENT).toPandas()
    lead, segment = (found[c].to_numpy(np.int64).view(np.uint64) for c in ("lead", "segment"))
    order = multikey_order([lead, segment]) if len(lead) else np.zeros(0, np.int64)
    at = order[np.linspace(0, len(order), buckets + 1).astype(int)[1:-1]] if len(order) > buckets else order
    return lead[at], segment[at]


def bucket_of(lead: np.ndarray, segment: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each suffix, and whether its leading bytes are on a splitter."""
    leads, seconds = bounds
    low, high = np.searchsorted(leads, lead, "left"), np.searchsorted(leads, lead, "right")
    on = low < high
    out = high.copy()
    for i in np.unique(low[on]).tolist():
        rows = np.flatnonzero(on & (low == i))
        j = int(high[rows[0]])
        out[rows] = i + np.searchsorted(seconds[i:j], segment[rows], "right")
    return out, on


def send_anchors(docs: DataFrame, bounds: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(bounds)

    def flush(chunk: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        lead, token, segment, doc, start, n = (np.concatenate([s[c] for s in chunk]) for c in ("lead", "token", "segment", "doc", "start", "n"))
        order = np.lexsort([start, doc, segment])
        once = order[np.concatenate([[True], segment[order][1:] != segment[order][:-1]])]
        lead, token, segment, doc, start, n = (c[once] for c in (lead, token, segment, doc, start, n))
        bucket, on = bucket_of(lead, segment, held.value)
        n = n | np.where(on, AMBIGUOUS, 0).astype(np.uint16)
        short = (token >> np.uint64(32)).astype(np.uint32)
        return _rows([(g, 0, pack([(short[r], False), (segment[r], False), (doc[r], True), (start[r], True), (n[r], False)])) for g, r in by_group(bucket, doc, start)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = [], 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for s in segments(data, offsets, _ids(batch)):
                chunk.append({c: s[c] for c in ("lead", "token", "segment", "doc", "start", "n")})
                size += len(s["lead"])
                if size >= CHUNK_ANCHORS:
                    yield flush(chunk)
                    chunk, size = [], 0
        if chunk:
            yield flush(chunk)

    return docs.mapInArrow(lean(run), _BLOBS)


def _gathered(table: pa.Table, kind: int, kinds: list[tuple[type, bool]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    columns: list[list[np.ndarray]] = [[] for _ in kinds]
    tails = []
    for k, blob in zip(table.column("kind").to_pylist(), table.column("blob")):
        if k == kind:
            values, tail = unpack(blob.as_py(), kinds)
            tails.append(tail)
            for c, v in zip(columns, values):
                c.append(v)
    return [np.concatenate(c) if c else np.zeros(0, k) for c, (k, _) in zip(columns, kinds)], tails


def earliest(anchors: DataFrame, parts: int) -> DataFrame:
    """The earliest of each segment, marked where windows have to be compared; by document part."""

    def bucket(table: pa.Table) -> pa.Table:
        (token, segment, doc, start, n), _ = _gathered(table, 0, ANCHORS)
        order = multikey_order([token, segment, doc, start])
        token, segment, doc, start, n = (c[order] for c in (token, segment, doc, start, n))
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (segment[1:] != segment[:-1])])
        token, doc, start, n = (c[new] for c in (token, doc, start, n))
        head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        count = np.diff(np.append(head, len(token)))
        on = np.logical_or.reduceat((n & AMBIGUOUS) > 0, head)
        flag = np.where((count > 1) | on, AMBIGUOUS, 0) + np.where((count > HOT) | on, IS_HOT, 0)
        n = ((n & 0xFF) | np.repeat(flag, count)).astype(np.uint16)
        return pa.Table.from_batches([_rows([(g, 1, pack([(doc[r], True), (start[r], True), (n[r], False)])) for g, r in by_group(part_of(doc, parts), doc, start)])])

    return anchors.groupBy("g").applyInArrow(lean_group(bucket), _BLOBS)


def send_documents(docs: DataFrame, parts: int) -> DataFrame:
    """Documents by part, in blobs of some ``CHUNK_BYTES`` of text per task and round."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        data, offsets = text_buffers(table.column(1))
        ids = table.column(0).fill_null(int(NULL_ID)).to_numpy().astype(np.int64)
        sizes, null = np.diff(offsets), table.column(0).is_null().to_numpy()
        return _rows([(g, 0, pack([(ids[r], False), (sizes[r], False), (null[r].astype(np.uint8), False)], b"".join(data[offsets[i] : offsets[i + 1]].tobytes() for i in r.tolist()))) for g, r in by_group(part_of(ids, parts))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= CHUNK_BYTES:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return docs.mapInArrow(lean(run), _BLOBS)


def _documents(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, null flags, offsets and bytes of a part."""
    (ids, sizes, null), tails = _gathered(table, 0, DOCS)
    return ids, null, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.concatenate(tails) if tails else np.zeros(0, np.uint8)


def send_ambiguous(part_rows: DataFrame, buckets: int) -> DataFrame:
    """Marked segments with their bytes by token, or window by window where the token is hot."""

    def run(table: pa.Table) -> pa.Table:
        ids, _, offsets, data = _documents(table)
        (doc, start, n), _ = _gathered(table, 1, MARKS)
        marked = (n & AMBIGUOUS) > 0
        doc, start, n = doc[marked], start[marked], n[marked]
        rows: list[tuple[int, int, bytes]] = []
        if len(doc) and len(ids):
            known = np.unique(ids)
            rank = np.searchsorted(known, doc)
            code = rank << 40 | start
            order = np.argsort(code)
            code, hot = code[order], (n[order] & IS_HOT) > 0
            for s in segments(data, offsets, ids):
                own = np.searchsorted(known, s["doc"]) << 40 | s["start"]
                at = np.minimum(np.searchsorted(code, own), len(code) - 1)
                found = np.flatnonzero(code[at] == own)
                is_hot = hot[at[found]]
                cold, warm = found[~is_hot], found[is_hot]
                # The first 32 bits of a token's hash are what the buckets of step 2 compared.
                place = ((s["token"] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                for g, r in by_group(place[cold], s["doc"][cold], s["start"][cold]) if len(cold) else ():
                    r = cold[r]
                    tail = b"".join(s["part"][a : b + LENGTH].tobytes() for a, b in zip(s["first"][r].tolist(), s["last"][r].tolist()))
                    rows.append((g, 0, pack([(s["token"][r], False), (s["doc"][r], True), (s["start"][r], True), (s["n"][r], False)], tail)))
                if len(warm):
                    count = s["n"][warm].astype(np.int64)
                    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    a = np.repeat(s["first"][warm], count) + step
                    h, h2 = window_hashes(s["prefix"], a)
                    d, x = np.repeat(s["doc"][warm], count), np.repeat(s["start"][warm], count) + step
                    for g, r in by_group((h % np.uint64(buckets)).astype(np.int64), d, x):
                        rows.append((buckets + g, 1, pack([(h[r], False), (h2[r], False), (d[r], True), (x[r], True)])))
        return pa.Table.from_batches([_rows(rows)])

    return part_rows.groupBy("g").applyInArrow(lean_group(run), _BLOBS)


def window_hashes(prefix: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each window."""
    half = LENGTH // 2
    return span_hash(prefix, start, start + LENGTH), mix64(span_hash(prefix, start, start + half) * np.uint64(3) + span_hash(prefix, start + half, start + LENGTH))


def compare_windows(ambiguous: DataFrame, parts: int) -> DataFrame:
    """Runs of windows that no other window precedes, by document part."""

    def run(table: pa.Table) -> pa.Table:
        hashes, seconds, docs, starts = [], [], [], []
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob")):
            if kind:
                (h, h2, doc, start), _ = unpack(blob.as_py(), WINDOWS)
            else:
                (token, doc, start, n), data = unpack(blob.as_py(), BYTES)
                count = n.astype(np.int64)
                size = count - 1 + LENGTH
                base = np.cumsum(size) - size
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                h, h2 = window_hashes(prefix_hash(data), np.repeat(base, count) + step)
                doc, start = np.repeat(doc, count), np.repeat(start, count) + step
            for c, v in zip((hashes, seconds, docs, starts), (h, h2, doc, start)):
                c.append(v)
        h, h2, doc, start = (np.concatenate(c) for c in (hashes, seconds, docs, starts))
        order = multikey_order([h, h2, doc, start])
        h, h2 = h[order], h2[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])])
        doc, start = doc[order][new], start[order][new]
        order = np.lexsort([start, doc])
        doc, start = doc[order], start[order]
        head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)]))
        doc, start, size = doc[head], start[head], np.diff(np.append(head, len(doc)))
        return pa.Table.from_batches([_rows([(g, 2, pack([(doc[r], True), (start[r], True), (size[r], False)])) for g, r in by_group(part_of(doc, parts), doc, start)])])

    return ambiguous.groupBy("g").applyInArrow(lean_group(run), _BLOBS)


_DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_FULL = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def removed_spans(size: int, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans under windows that are not among the kept runs."""
    if size < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    windows = size - LENGTH + 1
    edge = np.zeros(windows + 1, dtype=np.int64)
    ok = first < windows
    np.add.at(edge, first[ok], 1)
    np.add.at(edge, np.minimum(first[ok] + count[ok], windows), -1)
    repeat = np.cumsum(edge)[:windows] <= 0
    change = np.diff(repeat.astype(np.int8), prepend=0, append=0)
    lo, hi = np.flatnonzero(change == 1), np.flatnonzero(change == -1) + LENGTH - 1
    # Runs of repeats less than a window apart touch or overlap.
    if len(lo) > 1:
        apart = lo[1:] > hi[:-1]
        lo, hi = lo[np.concatenate([[True], apart])], hi[np.concatenate([apart, [True]])]
    return lo, hi


def apply_marks(part_rows: DataFrame, digest: bool) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        ids, null, offsets, data = _documents(table)
        (d1, s1, n1), _ = _gathered(table, 1, MARKS)
        (d2, s2, n2), _ = _gathered(table, 2, RUNS)
        plain = (n1 & AMBIGUOUS) == 0
        doc = np.concatenate([d1[plain], d2])
        start = np.concatenate([s1[plain], s2])
        count = np.concatenate([(n1[plain] & 0xFF).astype(np.int64), n2])
        order = np.argsort(doc, kind="stable")
        doc, start, count = doc[order], start[order], count[order]
        out: list[tuple] = []
        for i, (key, missing) in enumerate(zip(ids.tolist(), null.tolist())):
            raw = data[offsets[i] : offsets[i + 1]]
            a, b = np.searchsorted(doc, key), np.searchsorted(doc, key, "right")
            lo, hi = removed_spans(len(raw), start[a:b], count[a:b])
            bounds = np.concatenate([[0], np.stack([lo, hi], axis=1).ravel(), [len(raw)]]).astype(np.int64)
            kept = b"".join(raw[x:y].tobytes() for x, y in zip(bounds[::2].tolist(), bounds[1::2].tolist()))
            shown = None if missing else key
            if digest:
                out.append((shown, len(raw), int((hi - lo).sum()), len(lo), hashlib.sha256(kept).hexdigest()))
            else:
                out.append((shown, len(raw), [{"start": x, "end": y} for x, y in zip(lo.tolist(), hi.tolist())], kept))
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), *([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] if digest else [("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])])
        columns = list(zip(*out)) if out else [[] for _ in schema]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return part_rows.groupBy("g").applyInArrow(lean_group(run), _DIGEST if digest else _FULL)


def dedup_substrings(docs: DataFrame, digest: bool = False) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` per row: removed byte spans and the rest.

    With ``digest``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.
    """
    frame = id_and_text(docs)
    total = frame.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows")).first()
    size = total["bytes"] or 0
    buckets, parts = max(LEAST_BUCKETS, size // BUCKET_BYTES), max(LEAST_BUCKETS, size // PART_BYTES)
    bounds = splitters(frame, total["rows"], buckets)
    marks = checkpoint(earliest(send_anchors(frame, bounds), parts))
    texts = send_documents(frame, parts)
    firsts = compare_windows(send_ambiguous(texts.unionByName(marks), buckets), parts)
    return apply_marks(texts.unionByName(marks).unionByName(firsts), digest)
