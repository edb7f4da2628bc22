import time

import pytest
from pyspark.sql import functions as F

from siftgrid.operators import articles, chunking

STATUTE = """BİRİNCİ BÖLÜM
Genel Hükümler

Amaç
MADDE 1 – Bu Kanunun amacı işverenler ile işçiler arasındaki ilişkileri düzenlemektir.
12
Kapsam
MADDE 2 MADDE 2 – Bu Kanun bütün işyerlerine uygulanır.4 Ayrıca 4857 sayılı Kanun saklıdır.

1 12/5/2010 tarihli değişiklik notu
devamı notun

Fesih bildirimi
Madde 3l2 – Belirsiz süreli sözleşmelerin feshinden önce bildirim yapılır.

EK MADDE 1 – Ek hükümler bu maddede gösterilmiştir ve uygulanır.
GEÇİCİ MADDE 1 – Kısa.
MÜKERRER MADDE 2 – Mükerrer madde hükmü burada yer almaktadır ve uygulanır.
I SAYILI CETVEL
MADDE 99 – Cetvelde kalan metin sayılmaz çünkü ektir ve atılır.
"""


@pytest.fixture(scope="module")
def cut(spark):
    rows = [("İş Kanunu", "4857", "http://x", STATUTE), ("Boş", "1", "u", None), ("Tekrar", "7", "u", "MADDE 1 – " + "a b " * 30 + "\nMADDE 1 – " + "c d " * 30)]
    docs = spark.createDataFrame(rows, "law_name string, law_no string, source_url string, text string")
    return {r["id"]: r for r in articles.split_articles(docs).collect()}


def test_articles_and_ids(cut):
    assert set(cut) == {"4857_madde_1", "4857_madde_2", "4857_madde_312", "4857_ek_madde_1", "4857_mukerrer_madde_2", "7_madde_1", "7_madde_1_2"}


def test_titles(cut):
    assert cut["4857_madde_1"]["article_title"] == "Amaç"
    assert cut["4857_madde_2"]["article_title"] == "Kapsam"
    assert cut["4857_madde_312"]["article_title"] == "Fesih bildirimi"
    assert cut["4857_ek_madde_1"]["article_title"] == ""


def test_bodies(cut):
    one, two = cut["4857_madde_1"]["text"], cut["4857_madde_2"]["text"]
    assert one.startswith("Amaç\nMADDE 1") and "Kapsam" not in one and "\n12" not in one
    assert two.count("MADDE 2") == 1 and "uygulanır. Ayrıca" in two and "4857 sayılı" in two
    assert "notu" not in two and "devamı" not in two
    assert "Cetvel" not in cut["4857_mukerrer_madde_2"]["text"]


@pytest.mark.parametrize("line, yes", [("I. Genel kurallar", True), ("A) Fesih hakkı", True), ("a) Genel olarak:", True), ("a) işçi ayrılırsa", False), ("FESİH", True), ("1 - Genel hükümler", True), ("Bu madde uygulanır.", False), ("1/1/2020 tarihli", False), ("Sürelerin hesabı:", True), ("bu küçük harfle başlar", False), ("", False)])
def test_headings(line, yes):
    assert articles.is_heading(line) is yes


def test_trailing_titles():
    assert articles.trailing_title("metin biter – Yeni başlık:") == ("metin biter", "Yeni başlık:")
    assert articles.trailing_title("1. – Yeni başlık:") == ("", "Yeni başlık:") and articles.trailing_title("düz metin") == ("düz metin", "")
    assert articles.without_trailing_titles("Gövde cümlesi burada biter.\n\nYENİ BAŞLIK") == "Gövde cümlesi burada biter."
    assert articles.without_trailing_titles("gövde metni.\n\nYeni başlık", "Yeni başlık") == "gövde metni."
    assert articles.without_trailing_titles("Gövde biter. – Alt başlık:\n\nÜST BAŞLIK\n") == "Gövde biter."
    assert articles.tidy_title("Kapsam3") == "Kapsam" and articles.tidy_title("MADDE 5") == ""
    assert articles.tidy_title("12/3 md.") == "" and articles.tidy_title("(ibaresi çıkarılmıştır)") == ""


def test_titles_by_the_lines_above():
    long = "Bu maddede gösterilen esaslar bütün işyerlerinde uygulanır."
    cases = [
        ("Önceki madde burada biter.\nYıllık izin hakkı", "Yıllık izin hakkı"),
        ("Ücret hükümleri\nAsgari ücretin belirlenmesi", "Asgari ücretin belirlenmesi"),
        ("İKİNCİ BÖLÜM\nÇalışma süreleri ve dinlenme", "Çalışma süreleri ve dinlenme"),
        ("A) Genel kurallar\nI. Fesih hakkı:", "I. Fesih hakkı:"), ("A) Genel kurallar\nI - Fesih hakkı:", "Fesih hakkı:"),
        ("Eski başlık\n\nbu bir cümledir.", ""),
        ("", ""),
    ]
    for above, title in cases:
        (header, found, body), = articles.cut_articles(f"{above}\nMADDE 7 – {long}".strip())
        assert (header, found) == ("MADDE 7", title) and body.endswith(long)
    spread = articles.cut_articles(f"Madde\n8 – {long}\n3 Bu fıkra değişmiştir\ndevamı\nMADDE 9 MADDE 9 – {long}4 Son.")
    assert [(h, b.count("MADDE 9")) for h, _, b in spread] == [("Madde 8", 0), ("MADDE 9", 1)] and "devamı" not in spread[0][2]


def test_long_statutes_take_linear_time():
    one = "\n".join(f"Başlık metni\nMADDE {i} – " + "Bu madde uygulanır. " * 4 for i in range(4000))
    began = time.time()
    assert len(articles.cut_articles(one)) == 4000 and time.time() - began < 60


def test_units():
    assert chunking.units("kısa metin", 5) == ["kısa metin"]
    assert chunking.units("(1) a b c d\n(2) e f g h", 5) == ["(1) a b c d", "(2) e f g h"]
    assert chunking.units("Bir iki üç. Dört beş altı.", 4) == ["Bir iki üç.", "Dört beş altı."]
    assert chunking.units("a b c d e f g", 3) == ["a b c", "d e f", "g"]
    assert chunking.units("  ", 3) == []


def test_packing():
    w = lambda n: " ".join(["k"] * n)
    sizes = lambda parts, most, least: [chunking.count_words(c) for c in chunking.packed(parts, most, least)]
    assert sizes([w(6), w(6)], 10, 4) == [6, 6]
    assert sizes([w(2), w(9)], 10, 4) == [11]  # not cut off below the least size
    assert sizes([w(9), w(2)], 10, 4) == [11]  # a short tail joins
    assert sizes([w(10), w(10), w(3)], 10, 4) == [10, 13]
    assert sizes([w(12), w(3)], 10, 4) == [12, 3]  # unless it gets too long


def test_structured_chunks(spark):
    text = "\n\n".join("Cümle " + " ".join(f"k{i}_{j}" for j in range(99)) + "." for i in range(6))
    rows = [("a1", "L", "1", "Madde 1", "T", text, "u"), ("a2", "L", "1", "Madde 2", None, "kısa", "u"), ("a3", "L", "1", "Madde 3", "", None, "u")]
    df = spark.createDataFrame(rows, "id string, law_name string, law_no string, article_no string, article_title string, text string, source_url string")
    out = chunking.structured_chunks(df, 250, 120, 20).orderBy("id").collect()
    first = [r for r in out if r["parent_id"] == "a1"]
    assert [r["id"] for r in first] == ["a1_chunk_001", "a1_chunk_002", "a1_chunk_003"]
    assert [r["overlap_word_count"] for r in first] == [0, 20, 20] and [r["chunk_word_count"] for r in first] == [200, 220, 220]
    assert first[1]["text"].startswith("L (1) - Madde 1 - T\nk1_79") and first[0]["parent_word_count"] == 600
    short = next(r for r in out if r["parent_id"] == "a2")
    assert short["is_full_article"] and short["text"] == "L (1) - Madde 2\nkısa"
    assert chunking.structured_chunks(df.limit(0)).count() == 0


def test_sliding_chunks(spark):
    rows = [("a", "L", "1", "M", "", " ".join(map(str, range(25))), "u"), ("b", "L", "1", "M", "", "  ", "u")]
    df = spark.createDataFrame(rows, "id string, law_name string, law_no string, article_no string, article_title string, text string, source_url string")
    out = chunking.sliding_chunks(df, 10, 3).orderBy("id").collect()
    assert [r["text"].split("\n")[1].split()[0] for r in out] == ["0", "7", "14", "21"] and out[-1]["chunk_word_count"] == 4
    assert chunking.metadata(chunking.sliding_chunks(df, 10, 3)).agg(F.max("doc_id")).first()[0] == 3
