"""Gold references: law and article names to document ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.legal import EVALUATION_ALIASES, article_number, article_of_id, article_variants, first_mentioned_article, is_active, mentioned_articles, source_reference
from ..functions.text import normalize, split_list


def article_lookup(corpus: DataFrame) -> DataFrame:
    """``law_no, article, id``: each document under its article number and that of its id."""
    rows = corpus.where(F.trim(F.coalesce("law_no", F.lit(""))) != "").select("id", F.trim("law_no").alias("law_no"), "article_no")
    keys = F.array_distinct(F.array(article_number(F.col("article_no")), article_of_id(F.col("id"), F.col("law_no"))))
    return rows.select("law_no", F.explode(F.filter(keys, lambda k: k != "")).alias("article"), "id").distinct()


def law_names(corpus: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """``name, law_no`` of normalized law names and aliases (a dimension); aliases win."""
    spark = corpus.sparkSession
    known = corpus.where(F.trim("law_no") != "").select(normalize(F.col("law_name")).alias("name"), F.trim("law_no").alias("law_no"), F.lit(0).alias("own"))
    listed = spark.createDataFrame(list((EVALUATION_ALIASES if aliases is None else aliases).items()) or [("", "")], "alias string, law_no string")
    every = known.unionByName(listed.select(normalize(F.col("alias")).alias("name"), "law_no", F.lit(1).alias("own")))
    return every.where("name <> ''").groupBy("name").agg(F.max_by("law_no", F.struct("own", "law_no")).alias("law_no"))


def resolve(references: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, gold_ids`` for references ``(keys, law_no, article_no)``; unresolved ones are left out."""
    wanted = references.select(*keys, F.trim("law_no").alias("law_no"), F.explode(article_variants(F.col("article_no"))).alias("article"))
    found = wanted.join(lookup, ["law_no", "article"])
    return found.groupBy(*keys).agg(F.array_sort(F.collect_set("id")).alias("gold_ids"))


def infer_law(rows: DataFrame, names: DataFrame, fields: list[str], key: str, fold: Callable[[Column], Column] = normalize) -> DataFrame:
    """``key, law_no``: an exact field in field order, else the longest name that any field holds.

    Names are a dimension and broadcast; the text test runs only for rows
    without an exact field.  ``fold`` makes of a field what names are made of.
    """
    tidy = [fold(F.coalesce(F.col(c), F.lit(""))) for c in fields]
    frame = rows.select(key, F.array(*tidy).alias("fields"))
    exact = frame.select(key, F.posexplode("fields").alias("at", "name")).join(F.broadcast(names), "name").groupBy(key).agg(F.min_by("law_no", "at").alias("law_no"))
    rest = frame.join(exact.select(key), key, "left_anti").select(key, F.array_join("fields", " ").alias("joined"))
    held = rest.join(F.broadcast(names), F.contains("joined", "name")).groupBy(key).agg(F.max_by("law_no", F.struct(F.length("name"), F.col("name"))).alias("law_no"))
    return exact.unionByName(held)


def hints(questions: DataFrame, names: DataFrame, key: str = "query_id", text: str = "question") -> DataFrame:
    """``query_id, law_hints, article_hints``: every law and article that a question names."""
    rows = questions.select(F.col(key).alias("query_id"), F.col(text).alias("q"))
    laws = rows.select("query_id", normalize(F.coalesce("q", F.lit(""))).alias("plain")).join(F.broadcast(names), F.contains("plain", "name")).groupBy("query_id").agg(F.array_sort(F.collect_set("law_no")).alias("law_hints"))
    articles = F.array_sort(F.array_distinct(F.flatten(F.transform(mentioned_articles(F.col("q")), article_variants))))
    none = F.array().cast("array<string>")
    return rows.select("query_id", articles.alias("article_hints")).join(laws, "query_id", "left").select("query_id", F.coalesce("law_hints", none).alias("law_hints"), "article_hints")


def chunk_keys(chunks: DataFrame) -> DataFrame:
    """``doc_id, law_no, article_keys`` of chunks, from their article and their parent's id."""
    law, parent = F.trim(F.coalesce("law_no", F.lit(""))), F.coalesce("parent_id", F.lit(""))
    own = F.when((law != "") & (parent != ""), F.array(article_of_id(parent, law))).otherwise(F.array().cast("array<string>"))
    return chunks.select("doc_id", law.alias("law_no"), F.filter(F.array_union(article_variants(F.col("article_no")), own), lambda k: k != "").alias("article_keys"))


def article_numbers(numbers: Column, listed: Column, context: Column) -> Column:
    """Numbers of the first field that has any, else the first one mentioned in the context."""
    a, b = split_list(numbers), split_list(listed)
    return F.when(F.size(a) > 0, a).when(F.size(b) > 0, b).otherwise(F.array(first_mentioned_article(context)))


def from_table(rows: DataFrame, corpus: DataFrame, active_only: bool = True, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Gold examples of a benchmark table and counts by status.

    ``rows(position, row_id, soru, context, kaynak, kanun_adi, madde_no,
    madde_nolari_context, is_active)``, all strings but ``position``.
    """
    names = names if names is not None else law_names(corpus)
    laws = infer_law(rows, names, ["kanun_adi", "kaynak", "soru", "context"], "position")
    named = rows.join(laws, "position", "left").withColumn("articles", article_numbers(F.col("madde_no"), F.col("madde_nolari_context"), F.col("context")))
    gold = resolve(named.select("position", "law_no", F.explode("articles").alias("article_no")), article_lookup(corpus), ["position"])
    inactive = ~is_active(F.col("is_active")) if active_only else F.lit(False)
    status = F.when(inactive, "skipped_inactive").when(F.col("law_no").isNull(), "skipped_unresolved_law").when(F.col("gold_ids").isNull(), "skipped_unresolved_article").otherwise("resolved_examples")
    every = named.join(gold, "position", "left").withColumn("status", status)
    question_id = F.coalesce(F.nullif(F.col("row_id"), F.lit("")), F.format_string("csv_%04d", F.col("position")))
    examples = every.where("status = 'resolved_examples'").select(question_id.alias("question_id"), F.col("soru").alias("question"), F.col("gold_ids").alias("gold_parent_ids"))
    return examples, every.groupBy("status").agg(F.count("*").alias("n"))


def from_sources(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """Gold examples of ``rows(position, question_id, question, gold_sources)``.

    A source counts by a known id in any of its id fields, in order; else by
    its law and article, or by those that its ids or label spell out.
    """
    sources = rows.select("position", F.explode("gold_sources").alias("s"))
    blank = F.lit("")
    explicit = F.coalesce(*[F.nullif(F.trim(F.col(f"s.{c}")), blank) for c in ("corpus_row_id", "parent_id", "doc_id", "source_id")])
    spelled = F.coalesce(*[source_reference(F.col(f"s.{c}")) for c in ("source_id", "corpus_row_id", "citation_label")])
    law, article = F.trim(F.coalesce("s.law_no", blank)), F.trim(F.coalesce("s.article_no", blank))
    whole = (law != "") & (article != "")
    frame = sources.select("position", explicit.alias("explicit"), F.when(whole, law).otherwise(F.coalesce(spelled["law_no"], law)).alias("law_no"), F.when(whole, article).otherwise(F.coalesce(spelled["article_no"], article)).alias("article_no"))
    known = corpus.where(F.trim("law_no") != "").select(F.col("id").alias("explicit")).distinct().withColumn("known", F.lit(True))
    frame = frame.join(known, "explicit", "left")
    by_id = frame.where("known").groupBy("position").agg(F.collect_set("explicit").alias("gold_ids"))
    by_name = resolve(frame.where("known is null"), article_lookup(corpus), ["position"])
    gold = by_id.unionByName(by_name).groupBy("position").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gold_ids")))).alias("gold_parent_ids"))
    return rows.join(gold, "position").select(F.coalesce(F.nullif(F.col("question_id"), blank), F.format_string("json_%04d", F.col("position"))).alias("question_id"), "question", "gold_parent_ids")
