"""The pipeline on a small corpus with planted cases."""

import random

import pytest

import corpus_pipeline
from siftgrid.llm import decontaminate, pii


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(21)
    say = lambda n: " ".join("".join(rnd.choice(("an", "the", "er", "ing", "ou", "st", "re")) for _ in range(rnd.randint(1, 3))) for _ in range(n))
    item = say(30)
    rows, labels = [], []
    for i in range(300):
        toxic = i % 6 == 0
        text = say(60) + (" vilemost grubo " + say(5) if toxic else "")
        rows.append([i, text])
        labels.append((i, 1, int(toxic)))
    clean = [i for i in range(300) if i % 6]
    rows.append([1000, rows[clean[0]][1]])  # exact copy
    changed = rows[clean[1]][1].split()
    changed[30] = "other"
    rows.append([1001, " ".join(changed)])  # near copy
    rows.append([1002, say(40) + " " + item + " " + say(40)])  # leak
    rows.append([1003, say(40) + " reach me at jo.doe@mail.example.org or 10.1.2.3 " + say(10)])
    rows += [[1004, None], [1005, ""]]
    out = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    toxic = {i for i in range(300) if i % 6 == 0}
    assert not toxic & set(seen["toxicity"]) and len(seen["toxicity"]) == 306 - len(toxic)
    # Copies go, and of the texts without words one.
    assert set(seen["toxicity"]) - set(seen["near_duplicates"]) == {1000, 1001, 1005}
    cleaned = seen["decontamination"][1002]["text"]
    item = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert decontaminate.match_items(spark.createDataFrame([(1, cleaned)], "doc_id long, text string"), item).first()["spans"] == []
    assert seen["decontamination"][1002]["n_chars"] == len(cleaned)
    text = seen["pii"][1003]["text"]
    assert "[EMAIL]" in text and "[IP]" in text and not any(pii.base_spans(text).values())
    assert set(seen["byte_bpe"]) == set(seen["pii"])
    assert seen["byte_bpe"][1004]["n_tokens"] == 0


def test_run_equals_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns)
    assert out.count() == 306 - 50 - 3
