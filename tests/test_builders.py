import pytest

from siftgrid.operators import bm25, pairs
from siftgrid.plans import builders
from siftgrid.sources import writers


def test_clean_pairs_and_counters(spark):
    questions = spark.createDataFrame([(1, "p"), (2, "q"), (3, "none"), (4, None)], "query_id int, positive_parent_id string")
    chunks = spark.createDataFrame([(i, f"c{i}", p, i) for i, p in enumerate("pppqr")], "doc_id long, id string, parent_id string, chunk_index int")
    found = spark.createDataFrame([(q, d, 9.0 - d, d + 1) for q in (1, 2, 3, 4) for d in range(5)], "query_id int, doc_id long, bm25 double, rank int")
    rows = builders.clean_pairs(questions, chunks, found, 2, 3)
    got = sorted((r["query_id"], r["label"], r["doc_id"]) for r in rows.collect())
    assert got == [(1, 0, 3), (1, 0, 4), (1, 1, 0), (1, 1, 1), (2, 0, 0), (2, 0, 1), (2, 0, 2), (2, 1, 3)]
    assert builders.pair_counters(questions, rows, 3).first().asDict() == {"input_questions": 4, "skipped_no_positive": 2, "queries_used": 2, "queries_with_few_negatives": 1, "positive_rows": 3, "negative_rows": 5}
    assert builders.pair_counters(questions.limit(0), rows.limit(0)).first()["positive_rows"] == 0


def test_answer_pairs(spark):
    docs = spark.createDataFrame([(1, "kira sözleşmesi tahliye"), (2, "kira bedeli artışı"), (3, "işçi ücreti"), (4, "ceza")], "doc_id long, text string")
    examples = spark.createDataFrame([(1, "kira nedir", "tahliye", "sözleşmesi"), (2, "uzay", None, "")], "query_id int, question string, answer string, context string")
    rows = builders.answer_pairs(examples, bm25.build_index(docs), 0.5, 3).collect()
    assert [(r["query_id"], r["doc_id"]) for r in rows if r["label"] == 1] == [(1, 1)]
    bad = {r["doc_id"]: r["kind"] for r in rows if r["label"] == 0}
    assert bad == {2: "bm25", 3: "random", 4: "random"}


def test_explicit_articles_last_writer_wins(spark):
    articles = spark.createDataFrame([(1, "a", "4857", "Madde 5"), (2, "b", "4857", "Madde 5"), (3, "c", "4857", "Madde 7/A"), (4, "d", "1", "Madde 5"), (5, "e", "4857", None)], "position int, id string, law_no string, article_no string")
    questions = spark.createDataFrame([(1, "iş kanunu madde 5 nedir", "4857"), (2, "madde 7/a nedir", "4857"), (3, "kira nedir", "4857"), (4, None, "4857"), (5, "madde 5", None)], "query_id int, question string, law_no string")
    assert sorted(builders.explicit_articles(questions, articles).collect()) == [(1, "b"), (2, "c")]


@pytest.mark.parametrize("excluded", [0, 30])
def test_top_up_reaches_what_the_corpus_has(spark, excluded):
    # Most articles belong to the query's own parent, or are found already.
    corpus = [(i, "own") for i in range(500)] + [(500 + i, f"p{i}") for i in range(40)]
    found = [(1, 500 + i) for i in range(excluded)]
    queries = spark.createDataFrame([(1, "own"), (2, "p3")], "query_id int, positive_parent_id string")
    out = pairs.top_up_negatives(spark.createDataFrame(found, "query_id int, doc_id long"), queries, spark.createDataFrame(corpus, "doc_id long, parent_id string"), 35).collect()
    mine = [r["doc_id"] for r in out if r["query_id"] == 1]
    assert len(mine) == len(set(mine)) == 35 - excluded and not set(mine) & {d for _, d in found}
    assert all(r["parent_id"] != {1: "own", 2: "p3"}[r["query_id"]] for r in out)
    assert sum(r["query_id"] == 2 for r in out) == 35


def test_summaries_are_whole_or_refused(spark):
    assert writers.summary_json(spark.range(2)).count("id") == 2
    with pytest.raises(ValueError):
        writers.summary_json(spark.range(writers.MAX_SUMMARY_ROWS + 1))
