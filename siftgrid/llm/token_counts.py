"""Token counts per field or section by offset mapping (operator 2).

Each whole document is encoded once; the byte lengths of its tokens give their
character spans, and an interval join assigns the tokens to sections.  A token
that crosses a section boundary is allocated by an explicit rule:

* ``start``     - to the section that holds its first character,
* ``end``       - to the section that holds its last character,
* ``majority``  - to the section that holds most of its characters, ties to the
  earlier one.

A token whose deciding character lies in no section counts for section -1
(reported only if it has tokens).  A token that is part of a code point is
taken to span that code point.  Sections of a document must not overlap.

Defined results: null and empty texts have one empty section 0 without tokens;
repeated rows are counted one by one; the last section ends at the text's end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load_ranks
from .common import id_and_text, lean

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RULES = ("start", "end", "majority")

_WORKER: dict[str, tuple[tiktoken.Encoding, np.ndarray]] = {}


def worker_encoding(name: str, ranks: dict[bytes, int], pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding and the byte length of each id."""
    if name not in _WORKER:
        sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _WORKER[name] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _WORKER[name]


def line_sections(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds of lines; a line holds its line feed, and no line is empty at the end."""
    cuts = np.flatnonzero(raw == 10) + 1
    bounds = np.concatenate([[0], cuts[cuts < len(raw)], [len(raw)]])
    return bounds[:-1], bounds[1:]


def char_positions(raw: np.ndarray) -> np.ndarray:
    """p[i]: code points that start before byte i, for i up to len(raw)."""
    out = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out


def token_chars(chars: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character span of each token from the byte positions where tokens end."""
    starts = np.concatenate([[0], ends]).astype(np.int64)[:-1]
    first = np.maximum(chars[np.minimum(starts + 1, len(chars) - 1)] - 1, 0)
    return first, chars[ends]


def attribute(first: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Interval join of token spans with sorted, disjoint sections.

    Returns the section number of each token (-1: none) and whether it crosses
    the bounds of the section that holds its first character.
    """
    if not len(lo):
        return np.full(len(first), -1, dtype=np.int64), np.zeros(len(first), dtype=bool)

    def at(char: np.ndarray) -> np.ndarray:
        k = np.searchsorted(lo, char, "right") - 1
        return np.where((k >= 0) & (char < hi[np.maximum(k, 0)]), k, -1)

    head, tail = at(first), at(end - 1)
    crosses = (head != tail) | ((head >= 0) & (end > hi[np.maximum(head, 0)]))
    if rule == "start":
        return head, crosses
    if rule == "end":
        return tail, crosses
    best = head.copy()
    for i in np.flatnonzero(crosses).tolist():
        k0, k1 = np.searchsorted(hi, first[i], "right"), np.searchsorted(lo, end[i], "left")
        held = np.minimum(hi[k0:k1], end[i]) - np.maximum(lo[k0:k1], first[i])
        best[i] = k0 + int(np.argmax(held)) if len(held) and held.max() > 0 else -1
    return best, crosses


_SCHEMA = "doc_id long, section long, char_start long, char_end long, n_tokens long, n_crossing long"


def count_tokens(docs: DataFrame, sections: DataFrame | None = None, rule: str = "start", vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, split: Callable = line_sections) -> DataFrame:
    """``doc_id, section, char_start, char_end, n_tokens, n_crossing``.

    Without ``sections`` a document's sections come from ``split`` (its lines).
    With ``sections(doc_id, section, char_start, char_end)`` they are joined by
    document; sections of unknown or null documents don't count, and a
    document without sections has all its tokens in section -1.
    ``n_crossing`` counts the section's tokens that cross a boundary.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    frame = id_and_text(docs)
    given = sections is not None
    if given:
        cols = [F.col(c).cast("long").alias(c) for c in ("section", "char_start", "char_end")]
        held = sections.select(F.col("doc_id").cast("long").alias("sec_doc"), F.struct(*[cols[1], cols[2], cols[0]]).alias("s")).where("sec_doc is not null").groupBy("sec_doc").agg(F.array_sort(F.collect_list("s")).alias("sections"))
        frame = frame.join(held, F.col("doc_id") == F.col("sec_doc"), "left").drop("sec_doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = worker_encoding(vocabulary, ranks.value, pattern)
        for batch in batches:
            rows: list[list[np.ndarray]] = []
            own = batch.column(2).to_pylist() if given else None
            for i, scalar in enumerate(batch.column(1)):
                text = scalar.as_py() or ""
                raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
                chars = char_positions(raw)
                ends = np.cumsum(sizes[encoding.encode_to_numpy(text, disallowed_special=())]) if text else np.zeros(0, np.int64)
                first, end = token_chars(chars, ends)
                if given:
                    listed = own[i] or []
                    lo, hi, number = (np.array([s[c] for s in listed], dtype=np.int64) for c in ("char_start", "char_end", "section"))
                else:
                    a, b = split(raw)
                    lo, hi, number = chars[a], chars[b], np.arange(len(a), dtype=np.int64)
                of, crosses = attribute(first, end, lo, hi, rule)
                n, x = np.bincount(of + 1, minlength=len(lo) + 1), np.bincount(of[crosses] + 1, minlength=len(lo) + 1)
                keep = slice(0 if n[0] else 1, None)
                rows.append([np.full(len(n), i)[keep], np.concatenate([[-1], number])[keep], np.concatenate([[0], lo])[keep], np.concatenate([[len(chars) and chars[-1]], hi])[keep], n[keep], x[keep]])
            if not rows:
                continue
            at, *rest = (np.concatenate(c) for c in zip(*rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, pa.int64()) for c in rest)], ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"])

    return frame.mapInArrow(lean(run), _SCHEMA)
