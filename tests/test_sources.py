import json

import pytest
from pyspark.sql import functions as F

from siftgrid.operators.bm25 import search
from siftgrid.sources import readers, writers
from siftgrid.streaming import ingest


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.json").write_text("﻿" + json.dumps({"documents": [{"content": "first text", "law_no": "7", "title": "T"}, {"content": " "}]}), "utf-8")
    (tmp_path / "b.jsonl").write_text('{"text": "second", "id": "Çok Özel"}\n\n{"text": "third", "id": "Çok Özel"}\n', "utf-8")
    (tmp_path / "c.csv").write_bytes("﻿metin,kaynak,doc_no\n\"virgül, içinde\",Kaynak,12\n".encode())
    sub = tmp_path / "sub"
    sub.mkdir()
    (sub / "note.txt").write_bytes(b"plain \xff text")
    (sub / "skip.bin").write_bytes(b"x")
    return str(tmp_path)


def test_documents_of_a_folder(spark, folder):
    rows = {r["text"]: r for r in readers.normalize_documents(readers.read_documents(spark, folder)).collect()}
    assert set(rows) == {"first text", "second", "third", "virgül, içinde", "plain  text"}
    assert rows["second"]["id"] == "cok_ozel" and rows["third"]["id"] == "cok_ozel_2"
    assert rows["first text"]["law_no"] == "7" and rows["first text"]["id"].startswith("7_doc_0001_")
    assert rows["virgül, içinde"]["article_no"] == "12" and rows["virgül, içinde"]["law_name"] == "Kaynak"
    assert rows["plain  text"]["article_title"] == "note" and rows["plain  text"]["law_no"] == "CUSTOM"


def test_empty_folder_raises(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"x")
    with pytest.raises(ValueError):
        readers.read_documents(spark, str(tmp_path))


def test_bad_lines_raise(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "x.jsonl")).collect()
    assert readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), strict=False).count() == 1


def test_benchmarks(spark, tmp_path):
    (tmp_path / "b.csv").write_text("question,answer,corpus_row_id\nNe?,Şu,b|a;a\n,boş,c\n", "utf-8")
    row = readers.read_benchmark(spark, str(tmp_path / "b.csv")).collect()
    assert [(r["question_id"], r["expected_answer"], r["gold_document_ids"]) for r in row] == [("custom_0001", "Şu", ["a", "b"])]
    (tmp_path / "b.json").write_text(json.dumps({"questions": [{"soru": "Kim?", "id": "q9", "gold_sources": [{"doc_id": "d1"}, {"parent_id": "d0"}]}]}), "utf-8")
    row = readers.read_benchmark(spark, str(tmp_path / "b.json")).first()
    assert (row["question_id"], row["gold_document_ids"]) == ("q9", ["d0", "d1"])
    with pytest.raises(ValueError):
        readers.read_benchmark(spark, str(tmp_path / "b.txt"))
    (tmp_path / "e.csv").write_text("question\n \n")
    with pytest.raises(ValueError):
        readers.read_benchmark(spark, str(tmp_path / "e.csv"))


def test_nested_records_and_scores(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps({"train": [{"q": "a"}], "more": {"dev": [{"q": "b"}]}}))
    raw = spark.read.option("multiLine", True).json(str(tmp_path / "n.json"))
    assert sorted(r["q"] for r in readers.records_of(raw).collect()) == ["a", "b"]
    (tmp_path / "s.json").write_text(json.dumps({"embedding_model": "m", "dense_raw_list": [[[3, 0.5], [4, 0.25]], [[3, 0.1]]]}))
    out = [tuple(r) for r in readers.read_dense_scores(spark, str(tmp_path / "s.json")).orderBy("query_no", "doc_id").collect()]
    assert out == [(0, 3, 0.5), (0, 4, 0.25), (1, 3, 0.1)]


def test_field_names_by_priority(spark):
    df = spark.createDataFrame([(" ", "b", "c")], "Passage string, candidate_passage string, context string")
    assert df.select(readers.present(df, ("passage", "context"), fold=True)).first()[0] == "c"
    assert df.select(readers.passage_column(df, True)).first()[0] == "b"


def test_registry(spark):
    docs = spark.createDataFrame([("x", "t", "text one", "file:/a/1.pdf"), ("y", "t", "text two", "file:/a/2.pdf")], "id string, title string, text string, source_url string")
    reg = readers.read_registry(spark, [{"file_name": "1.pdf", "law_name": "L", "law_no": "5", "source_url": "u"}])
    assert [r["law_no"] for r in readers.registered(docs, reg).collect()] == ["5"]
    assert readers.registered(docs, reg, "6").count() == 0


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "ş, \"x\"", None)], "a int, b string, c string")
    writers.write_jsonl(df, str(tmp_path / "j"))
    assert '"c":null' in "".join(p.read_text("utf-8") for p in (tmp_path / "j").glob("part*"))
    writers.write_csv(df, str(tmp_path / "c"), ["b", "a"])
    back = readers.read_csv(spark, str(tmp_path / "c"))
    assert back.columns == ["b", "a"] and back.first()["b"] == 'ş, "x"'
    assert writers.union_of([df, df.withColumn("z", F.lit(1))], ordered=False).columns == ["a", "b", "c", "z"]
    assert json.loads(writers.summary_json(df))["b"] == 'ş, "x"'
    writers.write_index(df, str(tmp_path / "i"), {"dim": 3})
    assert spark.read.parquet(str(tmp_path / "i" / "vectors")).count() == 1
    files = spark.createDataFrame([("/a/x", bytearray(b"1")), ("/a/y", bytearray(b"2"))], "path string, content binary")
    assert len(writers.fingerprint(files)) == 16 and writers.fingerprint(files) == writers.fingerprint(files.orderBy(F.desc("path")))
    shown = spark.createDataFrame([(1, 1, 0.5, 0.1, 0.2, "C", "a\nb")], "query_id int, rank int, score double, dense double, bm25 double, citation string, text string")
    assert writers.result_blocks(shown).first()["block"].endswith("C\na b")


def test_streamed_index_equals_batch(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    doc = lambda i, t: json.dumps({"id": i, "law_name": "L", "law_no": "1", "article_no": "M", "article_title": "", "text": t, "source_url": ""}) + "\n"
    (source / "1.json").write_text(doc("a", "kıdem tazminatı") + doc("b", "fesih bildirimi"), "utf-8")
    stream = lambda: ingest.start(ingest.document_stream(spark, str(source)), target, str(tmp_path / "cp")).awaitTermination(120)
    stream()
    (source / "2.json").write_text(doc("c", "kıdem süresi"), "utf-8")
    stream()
    asked = spark.createDataFrame([(1, "kıdem")], "query_id int, question string")
    found = search(ingest.stored_index(spark, target), asked, 5)
    assert sorted(r["doc_id"] for r in found.collect()) == ["a_chunk_001", "c_chunk_001"]
