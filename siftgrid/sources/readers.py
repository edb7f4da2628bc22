"""Readers for documents, benchmarks and training rows, and their unified schemas."""

from __future__ import annotations

from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import digest_id, first_present, slug
from ..operators.articles import unique_ids
from ..operators.numbering import numbered

TEXT_SUFFIXES, STRUCTURED_SUFFIXES = (".txt", ".md"), (".json", ".jsonl", ".csv")
# The names under which fields may come, best first.
TEXT_NAMES = ("text", "content", "context", "body", "metin")
LAW_NAMES = ("law_name", "kanun_adi", "kaynak", "source", "collection", "title")
TITLE_NAMES = ("article_title", "title", "heading", "baslik")
LAW_NUMBERS = ("law_no", "kanun_no", "doc_no")
ARTICLE_NUMBERS = ("article_no", "madde_no", "section", "doc_no")
URL_NAMES = ("source_url", "url", "path", "source")
ID_NAMES = ("id", "doc_id", "parent_id", "context_key")
QUESTION_NAMES = ("question", "soru", "query")
ANSWER_NAMES = ("expected_answer", "reference_answer", "gold_answer", "answer", "cevap")
GOLD_NAMES = ("expected_document_id", "corpus_row_id", "gold_parent_id", "parent_id", "doc_id", "source_id")
WRAPPERS = ("benchmark", "questions", "examples", "data")
PASSAGE_NAMES = ("passage", "candidate_passage", "positive_passage", "context")


def _columns(df: DataFrame, names, fold: bool = False) -> list:
    """The columns of ``df`` among ``names``, in the order of ``names``."""
    if fold:
        have = {c.casefold(): c for c in df.columns}
        return [F.col(f"`{have[n.casefold()]}`") for n in names if n.casefold() in have]
    return [F.col(f"`{n}`") for n in names if n in df.columns]


def present(df: DataFrame, names, default: str | None = "", fold: bool = False):
    """First of the named columns that is there and not blank."""
    return first_present(_columns(df, names, fold), default)


def passage_column(df: DataFrame, candidate_first: bool = False):
    names = (PASSAGE_NAMES[1], PASSAGE_NAMES[0], *PASSAGE_NAMES[2:]) if candidate_first else PASSAGE_NAMES
    return present(df, names)


# ---- files -----------------------------------------------------------------


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as strings; a byte order mark is no part of the first name."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_jsonl(spark: SparkSession, path: str | list[str], strict: bool = True, limit: int | None = None) -> DataFrame:
    """One object a line; blank lines are skipped.  ``strict`` fails on other lines."""
    df = spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return df.limit(limit) if limit else df


def read_json(spark: SparkSession, path: str | list[str], wrappers: tuple[str, ...] = ("documents",)) -> DataFrame:
    """A list of objects, one object, or an object that holds a list under a wrapper name."""
    df = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    for name in wrappers:
        if name in df.columns and isinstance(df.schema[name].dataType, T.ArrayType) and isinstance(df.schema[name].dataType.elementType, T.StructType):
            return df.where(F.col(name).isNotNull()).select(F.explode(name).alias("row")).select("row.*")
    return df


def records_of(df: DataFrame) -> DataFrame:
    """Objects in lists below any key of a JSON object, as one table (levels by schema)."""
    lists = []

    def walk(column, kind) -> None:
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            lists.append(df.where(column.isNotNull()).select(F.explode(column).alias("row")).select("row.*"))
        elif isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(column[f.name], f.dataType)

    for f in df.schema.fields:
        walk(F.col(f"`{f.name}`"), f.dataType)
    if not lists:
        return df.limit(0)
    out = lists[0]
    for other in lists[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A document per text file: name as title, id from its path; undecodable bytes are dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)

    def decode(batches):
        for batch in batches:
            texts = [(b or b"").decode("utf-8-sig", "ignore") for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["path", "text"])

    df = files.select("path", "content").mapInArrow(decode, "path string, text string")
    name = F.element_at(F.split("path", "/"), -1)
    return df.select(digest_id(F.col("path")).alias("id"), F.regexp_replace(name, r"\.[^.]*$", "").alias("title"), "text", F.col("path").alias("source_url"))


def read_pdfs(spark: SparkSession, path: str | list[str], joiner: str = "\n\n") -> DataFrame:
    """A document per PDF, pages joined; needs PyMuPDF on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)

    def extract(batches):
        import fitz

        for batch in batches:
            texts = []
            for raw in batch.column(1).to_pylist():
                with fitz.open(stream=raw, filetype="pdf") as pdf:
                    texts.append(joiner.join(page.get_text("text") for page in pdf))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["path", "text"])

    df = files.select("path", "content").mapInArrow(extract, "path string, text string")
    name = F.element_at(F.split("path", "/"), -1)
    return df.select(digest_id(F.col("path")).alias("id"), F.regexp_replace(name, r"\.[^.]*$", "").alias("title"), "text", F.col("path").alias("source_url"))


def list_files(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Paths below ``path`` by suffix, through Spark's file systems (names only)."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").collect()
    out: dict[str, list[str]] = {}
    for p in sorted(r["path"] for r in rows):
        out.setdefault(PurePosixPath(p).suffix.lower(), []).append(p)
    return out


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Rows of every supported file below ``path``; ``_file`` and ``_at`` give their order.

    Structured files are read by format, text files and PDFs as one document
    each; an unsupported or empty place raises.
    """
    files = list_files(spark, path)
    parts = []
    for suffix, read in ((".json", read_json), (".jsonl", read_jsonl), (".csv", read_csv)):
        # One reader per file: schemas of uploads differ.
        for one in files.get(suffix, []):
            parts.append(read(spark, one).withColumn("_file", F.lit(one)))
    texts = [p for s in TEXT_SUFFIXES for p in files.get(s, [])]
    if texts:
        parts.append(read_texts(spark, texts).withColumn("_file", F.col("source_url")))
    if files.get(".pdf"):
        parts.append(read_pdfs(spark, files[".pdf"]).withColumn("_file", F.col("source_url")))
    if not parts:
        raise ValueError(f"no supported documents under {path}")
    out = None
    for part in parts:
        tidy = part.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in part.columns]).withColumn("_at", F.monotonically_increasing_id())
        out = tidy if out is None else out.unionByName(tidy, allowMissingColumns=True)
    return out


def limited(df: DataFrame, order: list, n: int | None) -> DataFrame:
    return df.orderBy(*order).limit(n) if n else df


# ---- unified rows ----------------------------------------------------------


def normalize_documents(rows: DataFrame, collection: str = "Custom Documents", order: tuple[str, ...] = ("_file", "_at")) -> DataFrame:
    """Article rows of rows with any of the known field names; rows without text go.

    Numbers in defaults (``Doc 0001``) count all rows in order, those without
    text too; repeated ids get ``_2``, ``_3`` ...
    """
    order = [c for c in order if c in rows.columns]
    placed = numbered(rows, order or [F.monotonically_increasing_id()], "_n", 1)
    text = present(placed, TEXT_NAMES)
    law_no = present(placed, LAW_NUMBERS, "CUSTOM")
    article = F.coalesce(F.nullif(present(placed, ARTICLE_NUMBERS), F.lit("")), F.format_string("Doc %04d", F.col("_n")))
    given = present(placed, ID_NAMES)
    made = F.btrim(F.concat_ws("_", slug(law_no), slug(article), digest_id(text, "")), F.lit("_"))
    out = placed.select("_n", F.when(given != "", slug(given)).otherwise(made).alias("id"), present(placed, LAW_NAMES, collection).alias("law_name"), law_no.alias("law_no"), article.alias("article_no"), present(placed, TITLE_NAMES).alias("article_title"), text.alias("text"), present(placed, URL_NAMES).alias("source_url")).where("text <> ''")
    return unique_ids(out, ["_n"]).drop("_n")


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """``question_id, question, expected_answer, gold_document_ids`` of a CSV, JSON or JSONL file."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".csv":
        raw = read_csv(spark, path)
    elif suffix == ".jsonl":
        raw = read_jsonl(spark, path)
    elif suffix == ".json":
        raw = read_json(spark, path, WRAPPERS)
    else:
        raise ValueError("a benchmark is CSV, JSON or JSONL")
    rows = normalize_benchmark(raw)
    if rows.isEmpty():
        raise ValueError("no benchmark questions found")
    return rows


def normalize_benchmark(raw: DataFrame) -> DataFrame:
    placed = numbered(raw, [F.monotonically_increasing_id()], "_n", 1)
    listed = F.filter(F.transform(F.split(present(placed, GOLD_NAMES), "[|;,]"), F.trim), lambda x: x != "")
    if "gold_sources" in raw.columns and isinstance(raw.schema["gold_sources"].dataType, T.ArrayType):
        fields = [f.name for f in raw.schema["gold_sources"].dataType.elementType.fields]
        known = [n for n in GOLD_NAMES if n in fields]
        if known:
            more = F.filter(F.transform(F.coalesce("gold_sources", F.array().cast(raw.schema["gold_sources"].dataType)), lambda s: first_present([s[n] for n in known], "")), lambda x: x != "")
            listed = F.concat(listed, more)
    question_id = F.coalesce(F.nullif(present(placed, ("question_id", "row_id", "id")), F.lit("")), F.format_string("custom_%04d", F.col("_n")))
    return placed.select(question_id.alias("question_id"), present(placed, QUESTION_NAMES).alias("question"), present(placed, ANSWER_NAMES).alias("expected_answer"), F.array_sort(F.array_distinct(listed)).alias("gold_document_ids")).where("question <> ''")


def read_dense_scores(spark: SparkSession, path: str) -> DataFrame:
    """``query_no, doc_id, dense`` of precomputed scores: per query a list of (doc, score)."""
    raw = spark.read.option("multiLine", True).json(path)
    lists = raw.select(F.posexplode("dense_raw_list").alias("query_no", "pairs"))
    return lists.select("query_no", F.explode("pairs").alias("p")).select("query_no", F.col("p")[0].cast("long").alias("doc_id"), F.col("p")[1].cast("double").alias("dense"))


def read_registry(spark: SparkSession, entries: list[dict[str, str]]) -> DataFrame:
    """The registry of known files: ``file_name, law_name, law_no, source_url`` (a dimension)."""
    return spark.createDataFrame([(e["file_name"], e["law_name"], e["law_no"], e["source_url"]) for e in entries], "file_name string, law_name string, law_no string, source_url string")


def registered(documents: DataFrame, registry: DataFrame, law_no: str | None = None) -> DataFrame:
    """Documents whose file is in the registry, with its law; optionally of one law."""
    named = documents.withColumn("file_name", F.element_at(F.split("source_url", "/"), -1)).drop("source_url", "title", "id")
    out = named.join(F.broadcast(registry), "file_name")
    return out.where(F.col("law_no") == law_no) if law_no else out
