"""Tokenizers and token-set measures as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .text import normalize

RUNS = r"[\p{L}\p{N}]+"
ASCII_TURKISH_RUNS = "[0-9A-Za-zÇĞİÖŞÜçğıöşü]+"
GRAM = 4

# Number words, in the normalized and in the written form.
NUMBER_WORDS = {"0": "sifir", "1": "bir", "2": "iki", "3": "uc", "4": "dort", "5": "bes", "6": "alti", "7": "yedi", "8": "sekiz", "9": "dokuz", "10": "on"}
NUMBER_WORDS_WRITTEN = {"0": "sıfır", "1": "bir", "2": "iki", "3": "üç", "4": "dört", "5": "beş", "6": "altı", "7": "yedi", "8": "sekiz", "9": "dokuz", "10": "on"}

# Words that content tokens leave out, by use.
STOPWORDS = {
    "mining": "acaba altinda altina bir biri birini bu da de gore hangi icin ile ise kanun kanunda madde maddesi mi mu mudur nasil ne nedir olur olarak ve veya".split(),
    "questions": "acaba ama ancak bir biri birini bu da de diye gore hangi icin ile ise kanun kanuna kanunda madde maddede maddesi mi mu mudur nasil ne nedir olur olarak ve veya".split(),
    "alignment": "acaba altinda altina ama ancak bir biri birini bu da de diye gore hangi icin ile ise kanun kanuna kanunda kapsaminda madde maddede maddesi mi mu mudur nasil ne nedir olur olarak ve veya".split(),
    "titles": "acaba bir biri birini birine birinin bu hangi icin iş is işçi isci işçinin iscinin işçiye isciye işçiler isciler işveren isveren işverene isverene işverenin isverenin ile ise kanun kanuna kanunda madde maddesi mi mu mudur mı nasıl ne nedir olur olarak suç suc şart şartlar sart sartlar var ve veya".split(),
}


def runs(normalized: Column, pattern: str = RUNS) -> Column:
    return F.regexp_extract_all(normalized, F.lit(pattern), F.lit(0))


def char_grams(token: Column, size: int = GRAM) -> Column:
    """``char:`` n-grams of a token; none if it is shorter."""
    grams = F.transform(F.sequence(F.lit(1), F.length(token) - (size - 1)), lambda i: F.concat(F.lit("char:"), F.substring(token, i, F.lit(size))))
    return F.when(F.length(token) >= size, grams).otherwise(F.array().cast("array<string>"))


def all_grams(normalized: Column, size: int = GRAM) -> Column:
    """``char:`` n-grams of all runs of a text.

    A lookahead matches at every position, so that no function runs per token.
    """
    grams = F.regexp_extract_all(normalized, F.lit(rf"(?=([\p{{L}}\p{{N}}]{{{size}}}))"), F.lit(1))
    return F.transform(grams, lambda g: F.concat(F.lit("char:"), g))


def number_words(normalized: Column, letters: str, written: bool) -> Column:
    """Names of the numbers up to ten that stand alone."""
    table = NUMBER_WORDS_WRITTEN if written else NUMBER_WORDS
    names = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.regexp_extract_all(normalized, F.lit(f"(?<!{letters})(?:10|[0-9])(?!{letters})"), F.lit(0))
    return F.transform(found, lambda t: F.element_at(names, t))


# Terms are bags: their order doesn't matter, so runs come first, then what is made of them.


def index_terms(text: Column) -> Column:
    """Runs of at least two characters and their 4-grams: the terms of the lexical index."""
    plain = normalize(F.coalesce(text, F.lit("")))
    return F.concat(runs(plain, r"[\p{L}\p{N}]{2,}"), all_grams(plain))


def number_terms(text: Column, legacy: bool = False) -> Column:
    """Alphanumeric runs; numbers up to ten also by name.

    ``legacy`` adds the names with their accents, which normalized texts never
    hold, as an older tokenizer did.
    """
    plain = normalize(F.coalesce(text, F.lit("")))
    return F.concat(runs(plain, ASCII_TURKISH_RUNS), number_words(plain, ASCII_TURKISH_RUNS[:-1], legacy))


def number_gram_terms(text: Column, legacy: bool = False) -> Column:
    """Runs, number names and 4-grams of the runs, without a least length."""
    plain = normalize(F.coalesce(text, F.lit("")))
    return F.concat(runs(plain), number_words(plain, RUNS[:-1], legacy), all_grams(plain))


def _content_runs(text: Column) -> Column:
    """Runs of three and more characters that are not numbers."""
    return runs(normalize(F.coalesce(text, F.lit(""))), r"(?![0-9]+(?![\p{L}\p{N}]))[\p{L}\p{N}]{3,}")


def _stopwords(use: str) -> Column:
    return F.array(*[F.lit(w) for w in STOPWORDS[use]])


def content_terms(text: Column, stopwords: str = "mining") -> Column:
    """Runs of three and more characters that are no number and no stopword, in order."""
    stop = _stopwords(stopwords)
    return F.filter(_content_runs(text), lambda t: ~F.array_contains(stop, t))


def content_set(text: Column, stopwords: str = "mining") -> Column:
    """The distinct content terms, in order of appearance."""
    return F.array_except(_content_runs(text), _stopwords(stopwords))


def containment(left: Column, right: Column) -> Column:
    """Shared members over the size of the smaller set; 0 if either is empty."""
    least = F.least(F.size(left), F.size(right))
    return F.when(least > 0, F.size(F.array_intersect(left, right)) / least).otherwise(0.0)


def term_similarity(left: Column, right: Column) -> Column:
    """Dice coefficient of 4-gram sets; equal terms 1, terms without n-grams 0."""
    a, b = F.array_distinct(char_grams(left)), F.array_distinct(char_grams(right))
    dice = 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))
    return F.when(left == right, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(dice)


def best_similarity(left: Column, right: Column) -> Column:
    """Greatest similarity of any two terms of two lists; 0 if either is empty."""
    every = F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: term_similarity(x, y))))
    return F.coalesce(F.array_max(every), F.lit(0.0))


TITLE_MATCH, SINGLE_MATCH_CAP = 0.82, 0.45


def title_relevance(question: Column, title: Column) -> Column:
    """How directly a title names what a question asks for, from 0 to 1."""
    q, t = content_set(question, "titles"), content_set(title, "titles")

    def similar(x: str, y: str, a: set, b: set) -> bool:
        return x == y or bool(a and b) and 2 * len(a & b) / (len(a) + len(b)) >= TITLE_MATCH

    def score(asked: list, named: list) -> float:
        left, right = ([(x, {x[i : i + GRAM] for i in range(len(x) - GRAM + 1)}) for x in side] for side in (asked, named))
        hits = [(x, y) for x, a in left for y, b in right if similar(x, y, a, b)]
        q_hit, t_hit = len({x for x, _ in hits}), len({y for _, y in hits})
        t_share = t_hit / max(1, len(named))
        if q_hit == 0:
            return 0.0
        return min(SINGLE_MATCH_CAP, SINGLE_MATCH_CAP * t_share) if q_hit == 1 and t_hit == 1 else min(1.0, 0.35 * (q_hit / max(1, len(asked))) + 0.65 * t_share)

    def run(asked: pd.Series, named: pd.Series) -> pd.Series:
        return pd.Series([score(list(x), list(y)) for x, y in zip(asked, named)], dtype="float64")

    return pandas_udf(run, "double")(q, t)
