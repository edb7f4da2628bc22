"""Sinks: JSON, JSONL, CSV, vector tables and content-addressed folders."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite") -> None:
    """A header and fixed columns; without ``columns`` all of them, in order of first appearance."""
    (df.select(*columns) if columns else df).write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def union_of(parts: list[DataFrame], ordered: bool = True) -> DataFrame:
    """Rows of all parts; columns by first appearance, or sorted by name."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out if ordered else out.select(*sorted(out.columns))


#: A summary has so many rows at most.
MAX_SUMMARY_ROWS = 1000


def summary_json(df: DataFrame) -> str:
    """A summary as indented JSON; for counters and metrics, longer tables are an error."""
    rows = [r.asDict(recursive=True) for r in df.limit(MAX_SUMMARY_ROWS + 1).collect()]
    if len(rows) > MAX_SUMMARY_ROWS:
        raise ValueError(f"a summary has at most {MAX_SUMMARY_ROWS} rows")
    return json.dumps(rows[0] if len(rows) == 1 else rows, ensure_ascii=False, indent=2)


def write_index(chunks: DataFrame, path: str, config: dict, mode: str = "overwrite") -> None:
    """Vectors and metadata as one Parquet table, with the configuration beside it as JSON."""
    chunks.write.mode(mode).parquet(f"{path}/vectors")
    chunks.sparkSession.createDataFrame([(json.dumps(config, ensure_ascii=False),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/config")


def fingerprint(files: DataFrame) -> str:
    """16 hex digits over names and contents of ``files(path, content)``, in order of name.

    Contents are hashed where they are; only fixed-size hashes are gathered.
    """
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("h")).orderBy("name", "h")
    joined = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "h"))), lambda s: F.concat(s["name"], F.lit(":"), s["h"])), "|").alias("j"))
    return joined.select(F.left(F.sha2("j", 256), F.lit(16)).alias("f")).first()["f"]


def result_blocks(results: DataFrame, preview: int = 1200) -> DataFrame:
    """Readable blocks: rank and scores, citation, and the beginning of the text."""
    head = F.format_string("[%d] score=%.4f dense=%.4f bm25=%.4f", "rank", "score", "dense", "bm25")
    return results.select("query_id", "rank", F.concat_ws("\n", head, "citation", F.left(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(preview))).alias("block"))
