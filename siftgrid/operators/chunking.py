"""Passages from articles: sliding windows in the JVM, structure-aware packing in Arrow."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.legal import chunk_header
from ..functions.text import split_words, word_count
from .numbering import numbered

MAX_WORDS, MIN_WORDS, OVERLAP, WINDOW_OVERLAP = 450, 120, 80, 64
FIELDS = ("law_name", "law_no", "article_no", "article_title")

# What begins a clause, and where a sentence ends.
CLAUSE = re.compile(r"^\s*(?:\(?\d+\)|\d+[\).]|[a-zçğıöşü][\).]|[A-ZÇĞİÖŞÜ][\).]|[IVXLCDM]+[\).])\s+", re.M)
SENTENCE = re.compile(r"(?<=[.!?;:])\s+(?=\(?[A-ZÇĞİÖŞÜ0-9])")
BLANK_LINE = re.compile(r"\n\s*\n")


def sliding_chunks(articles: DataFrame, max_words: int = MAX_WORDS, overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """Windows of ``max_words`` words, each ``max_words - overlap`` after the one before.

    The last window is the first that reaches the end.  Texts without words
    give no chunk.  ``articles`` has ``id, text, source_url`` and the fields of
    a citation.
    """
    step = max(1, max_words - overlap)
    frame = articles.withColumn("words", split_words(F.coalesce("text", F.lit("")))).where(F.size("words") > 0)
    count = F.when(F.size("words") <= max_words, F.lit(1)).otherwise(F.ceil((F.size("words") - max_words) / step) + 1).cast("int")
    frame = frame.withColumn("chunk_count", count).withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("chunk_count") - 1)))
    body = F.slice("words", F.col("chunk_index") * step + 1, F.lit(max_words))
    return _chunk_columns(frame.withColumn("body", body), F.array_join("body", " "), F.size("body"), F.when(F.col("chunk_count") > 1, F.lit(overlap)).otherwise(0), F.size("words"))


def _chunk_columns(frame: DataFrame, body, n_words, n_overlap, n_parent) -> DataFrame:
    header = chunk_header(*[F.coalesce(F.col(c), F.lit("")) for c in FIELDS])
    return frame.select(
        F.format_string("%s_chunk_%03d", F.col("id"), F.col("chunk_index") + 1).alias("id"),
        F.col("id").alias("parent_id"),
        *FIELDS,
        F.col("chunk_index").cast("int").alias("chunk_index"),
        F.col("chunk_count").cast("int").alias("chunk_count"),
        (F.col("chunk_count") == 1).alias("is_full_article"),
        n_parent.cast("int").alias("parent_word_count"),
        n_words.cast("int").alias("chunk_word_count"),
        n_overlap.cast("int").alias("overlap_word_count"),
        F.trim(F.concat(header, F.lit("\n"), body)).alias("text"),
        "source_url",
    )


def count_words(text: str) -> int:
    return len(text.split())


def paragraphs(text: str) -> list[str]:
    """Parts between blank lines; a text without any is one part."""
    return [p.strip() for p in BLANK_LINE.split(text) if p.strip()] or [text.strip()]


def clauses(text: str) -> list[str]:
    """Parts that begin with a clause marker; one part if there are fewer than two markers."""
    marks = [m.start() for m in CLAUSE.finditer(text)]
    if len(marks) < 2:
        return [text.strip()]
    bounds = sorted({0, *marks, len(text)})
    return [p for a, b in zip(bounds, bounds[1:]) if (p := text[a:b].strip())] or [text.strip()]


def sentences(text: str) -> list[str]:
    return [p for p in (s.strip() for s in SENTENCE.split(text)) if p] or [text.strip()]


def units(text: str, max_words: int) -> list[str]:
    """Parts of at most ``max_words`` words: by clauses, else sentences, else word counts."""
    done: list[str] = []
    open_ = [text.strip()]
    while open_:
        part = open_.pop()
        words = part.split()
        if not words:
            continue
        if len(words) <= max_words:
            done.append(part)
            continue
        smaller = clauses(part)
        if len(smaller) < 2:
            smaller = sentences(part)
        if len(smaller) > 1:
            open_ += reversed(smaller)
        else:
            done += [" ".join(words[i : i + max_words]) for i in range(0, len(words), max_words)]
    return done


def packed(parts: list[str], max_words: int, min_words: int) -> list[str]:
    """Parts put together up to ``max_words``, but not cut off below ``min_words``.

    A last chunk under ``min_words`` joins the one before, unless together they
    exceed ``max_words + min_words``.
    """
    chunks: list[list[str]] = []
    size = 0
    for part in filter(None, (p.strip() for p in parts)):
        n = count_words(part)
        if not chunks or size + n > max_words and size >= min_words:
            chunks.append([])
            size = 0
        chunks[-1].append(part)
        size += n
    out = ["\n\n".join(c).strip() for c in chunks]
    if len(out) > 1 and size < min_words and count_words(out[-2]) + size <= max_words + min_words:
        out[-2:] = [f"{out[-2]}\n\n{out[-1]}"]
    return out


def bodies(text: str, max_words: int = MAX_WORDS, min_words: int = MIN_WORDS) -> list[str]:
    """Chunk bodies of a text, before any overlap."""
    text = text.strip()
    if count_words(text) <= max_words:
        return [text]
    return packed([u for p in paragraphs(text) for u in units(p, max_words)], max_words, min_words)


def structured_chunks(articles: DataFrame, max_words: int = MAX_WORDS, min_words: int = MIN_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """Chunks along paragraphs, clauses and sentences, with the last words of the chunk before.

    An article is cut by one task; its overlaps come with the bodies, so that
    no window over chunks (and no shuffle) is needed.
    """
    schema = "id string, body string, chunk_index int, chunk_count int, overlap string, words int"
    named = articles.select(F.struct("id", "source_url", *FIELDS).alias("article"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = bodies(text, max_words, min_words)
                n = count_words(text)
                for k, body in enumerate(own):
                    before = own[k - 1].split() if k and overlap > 0 else []
                    tail = "" if not before else own[k - 1].strip() if len(before) <= overlap else " ".join(before[-overlap:])
                    at.append(i)
                    rows.append((body, k, len(own), tail, n))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["article", "body", "chunk_index", "chunk_count", "overlap", "words"])

    kind = named.schema["article"].dataType.simpleString()
    cut = named.mapInArrow(run, f"article {kind}, " + schema.split(", ", 1)[1]).select("article.*", "body", "chunk_index", "chunk_count", "overlap", "words")
    whole = F.when(F.col("overlap") != "", F.trim(F.concat("overlap", F.lit("\n\n"), "body"))).otherwise(F.col("body"))
    return _chunk_columns(cut, whole, word_count(whole), word_count(F.col("overlap")), F.col("words"))


def metadata(chunks: DataFrame) -> DataFrame:
    """Chunks with an explicit ``doc_id`` (by id order) beside all their columns."""
    return numbered(chunks, ["id"], "doc_id")
