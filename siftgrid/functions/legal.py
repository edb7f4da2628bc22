"""Article numbers, citations, law names and question hygiene."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_space, normalize
from .tokens import runs

# Aliases of laws, for evaluation and for cleaning questions.
EVALUATION_ALIASES = {
    "bilgi edinme kanunu": "4982", "bilgi edinme hakki kanunu": "4982", "bilgi edinme hakkı kanunu": "4982",
    "turkiye cumhuriyeti is kanunu": "4857", "türkiye cumhuriyeti iş kanunu": "4857", "is kanunu": "4857", "iş kanunu": "4857",
    "turk medeni kanunu": "4721", "türk medeni kanunu": "4721", "turk medeni̇ kanunu": "4721",
    "turk ceza kanunu": "5237", "türk ceza kanunu": "5237", "ceza muhakemesi kanunu": "5271",
    "turk borclar kanunu": "6098", "türk borçlar kanunu": "6098",
    "turkiye cumhuriyeti anayasasi": "2709", "türkiye cumhuriyeti anayasası": "2709", "anayasa": "2709",
}
QUESTION_ALIASES = {
    "anayasa": "2709", "anayasasi": "2709", "turkiye cumhuriyeti anayasasi": "2709",
    "tck": "5237", "turk ceza kanunu": "5237", "ceza kanunu": "5237",
    "cmk": "5271", "ceza muhakemesi kanunu": "5271",
    "tmk": "4721", "turk medeni kanunu": "4721", "medeni kanun": "4721",
    "tbk": "6098", "turk borclar kanunu": "6098", "borclar kanunu": "6098",
    "is kanunu": "4857", "turkiye cumhuriyeti is kanunu": "4857",
    "kvkk": "6698", "kisisel verilerin korunmasi kanunu": "6698",
    "hukuk muhakemeleri kanunu": "6100", "hmk": "6100",
    "icra ve iflas kanunu": "2004", "iik": "2004",
    "turk ticaret kanunu": "6102", "ttk": "6102",
    "tuketici kanunu": "6502", "tuketicinin korunmasi hakkinda kanun": "6502",
    "bilgi edinme kanunu": "4982", "bilgi edinme hakki kanunu": "4982",
}

# Signs of unusable questions (on normalized text), generic titles and title words.
BAD_QUESTION_PATTERNS = (r"\boricon\b", r"kayna[gğ][aı]na g[oö]re", r"kaynak.*g[oö]re", r"metne g[oö]re", r"par[cç]aya g[oö]re", r"yukar[ıi]daki", r"a[sş]a[gğ][ıi]daki", r"\bkay[ıi]t\s*\d+", r"sizce neden", r"olay[ıi]n [oö]z[üu]", r"karar sonucu")
GENERIC_TITLES = ("amac", "kapsam", "tanimlar", "yururluk", "yurutme")
GENERIC_TITLE_WORDS = "amac ana basvuru bildirim diger esas genel hukum hukumler izin karar kapsam kosul olarak sure tanim tanimlar uygulama usul verilmesi yapilmasi".split()
IGNORED_LAW_WORDS = "turkiye cumhuriyeti kanunu kanun turk sayili hakkinda dair".split()
ARTICLE_MENTION = r"(?i)(?:madde|m\.?)\s*([0-9]+(?:/[a-z])?)"
SOURCE_ID = r"(?i)_([0-9]{3,4})_[a-z0-9_]+?_m([0-9]+(?:/[a-z])?)$"
QUESTION_ARTICLE_PATTERNS = (r"madde\s*(\d+)\s*/\s*([a-z])", r"madde\s*(\d+)\s*[-]?\s*([a-z])\b", r"(\d+)\s*[/]\s*([a-z])\s*(?:maddesi|madde)", r"madde\s*(\d+)", r"(\d+)\.\s*madd")
MIN_QUESTION, MAX_QUESTION = 18, 240


def article_number(text: Column) -> Column:
    """A comparable article number: no parentheses, no word for article, parts joined by ``_``."""
    value = F.regexp_replace(normalize(F.coalesce(text.cast("string"), F.lit(""))), r"\([^)]*\)", " ")
    value = F.regexp_replace(value, r"\b(madde|mad|m|article)\b\.?", " ")
    value = F.regexp_replace(F.regexp_replace(value, "[^a-z0-9/]+", " "), r"\s+", " ")
    return F.regexp_replace(F.replace(F.trim(value), F.lit(" "), F.lit("_")), "_+$", "")


def article_of_id(article_id: Column, law_no: Column) -> Column:
    """The article number inside an id ``<law>_madde_<n>``."""
    prefix = F.concat(law_no, F.lit("_"))
    rest = F.when(F.startswith(article_id, prefix), F.substring(article_id, F.length(prefix) + 1, F.length(article_id))).otherwise(article_id)
    return article_number(F.replace(rest, F.lit("madde_"), F.lit("")))


def article_variants(text: Column) -> Column:
    """The number, and without a leading ``ek_``, ``gecici_`` or ``mukerrer_``."""
    key = article_number(text)
    return F.filter(F.array_distinct(F.array(key, *[F.regexp_replace(key, f"^{p}", "") for p in ("ek_", "gecici_", "mukerrer_")])), lambda x: x != "")


def article_key(header: Column) -> Column:
    """The part of an article id that its header gives."""
    return F.btrim(F.regexp_replace(normalize(header), "[^a-z0-9/]+", "_"), F.lit("_"))


def mentioned_articles(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ARTICLE_MENTION), F.lit(1))


def first_mentioned_article(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), ARTICLE_MENTION, 1)


def source_reference(text: Column) -> Column:
    """(law, article) of an id that ends in ``_<law>_<name>_m<article>``; null if it doesn't."""
    law = F.regexp_extract(F.coalesce(text, F.lit("")), SOURCE_ID, 1)
    return F.when(law != "", F.struct(law.alias("law_no"), F.regexp_extract(text, SOURCE_ID, 2).alias("article_no")))


def question_article(question: Column) -> Column:
    """The article that a question names, ``n`` or ``n/letter``; empty if none."""
    text = normalize(F.coalesce(question, F.lit("")))
    found = []
    for pattern in QUESTION_ARTICLE_PATTERNS:
        number = F.regexp_extract(text, pattern, 1)
        whole = F.concat(number, F.lit("/"), F.regexp_extract(text, pattern, 2)) if "[a-z]" in pattern else number
        found.append(F.when(number != "", whole))
    return F.coalesce(*found, F.lit(""))


def article_sort_key(article_no: Column) -> Column:
    return F.replace(F.replace(normalize(article_no), F.lit("madde"), F.lit("")), F.lit(" "), F.lit(""))


def citation(law_name: Column, law_no: Column, article_no: Column, title: Column) -> Column:
    """``law (no), article`` and `` - title`` if there is one."""
    empty = F.lit("")
    base = F.concat(F.coalesce(law_name, empty), F.lit(" ("), F.coalesce(law_no, empty), F.lit("), "), F.coalesce(article_no, empty))
    tidy = F.trim(F.coalesce(title, empty))
    return F.when(tidy != "", F.concat(base, F.lit(" - "), tidy)).otherwise(base)


def chunk_header(law_name: Column, law_no: Column, article_no: Column, title: Column) -> Column:
    return F.concat_ws(" - ", F.concat(law_name, F.lit(" ("), law_no, F.lit(")")), article_no, F.nullif(F.trim(F.coalesce(title, F.lit(""))), F.lit("")))


def article_passage(law_name: Column, law_no: Column, article_no: Column, title: Column, text: Column) -> Column:
    return F.concat(citation(law_name, law_no, article_no, title), F.lit("\n"), text)


def searchable(*columns: Column) -> Column:
    """Fields joined by blanks; a missing one counts as empty."""
    return F.array_join(F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), " ")


def is_active(flag: Column) -> Column:
    return F.coalesce(F.lower(flag.cast("string")) == "true", F.lit(False))


def is_bad_question(question: Column) -> Column:
    text = F.coalesce(question, F.lit(""))
    size = F.length(text)
    return (size < MIN_QUESTION) | (size > MAX_QUESTION) | normalize(text).rlike("|".join(f"(?:{p})" for p in BAD_QUESTION_PATTERNS))


def readable_question(question: Column) -> Column:
    text = clean_space(question)
    return F.when((text != "") & ~F.endswith(text, F.lit("?")), F.concat(text, F.lit("?"))).otherwise(text)


def clean_title(title: Column) -> Column:
    """A title without enumerators and outer punctuation."""
    out = F.btrim(clean_space(title), F.lit(":;-"))
    for pattern in (r"(?i)^[IVXLCDM]+\s*[-.)]\s*", r"^\d+\s*[-.)]\s*", r"(?iu)^[a-zçğıöşü]\s*[-.)]\s*"):
        out = F.regexp_replace(out, pattern, "")
    return F.btrim(clean_space(out), F.lit(":;-"))


def is_useful_title(title: Column) -> Column:
    """At least twelve characters and two words that are not generic."""
    tidy = clean_title(title)
    generic = F.array(*[F.lit(w) for w in GENERIC_TITLE_WORDS])
    good = F.filter(runs(normalize(tidy)), lambda t: (F.length(t) > 2) & ~F.array_contains(generic, t))
    return (F.size(good) >= 2) & (F.length(tidy) >= 12)


def law_words(name: Column) -> Column:
    ignored = F.array(*[F.lit(w) for w in IGNORED_LAW_WORDS])
    return F.array_distinct(F.filter(runs(normalize(F.coalesce(name, F.lit("")))), lambda t: (F.length(t) > 2) & ~F.array_contains(ignored, t)))


# Expansions of colloquial questions.
_TWO_DAYS = "iki iki gün iki işgünü ardı ardına"
_ABSENCE = "işçinin işverenden izin almaksızın haklı bir sebebe dayanmaksızın ardı ardına iki işgünü işine devam etmemesi devamsızlık işverenin haklı nedenle derhal fesih hakkı"
_KILLING = "kasten öldürme insan öldürme bir insanı kasten öldüren kişi müebbet hapis Türk Ceza Kanunu hayata karşı suçlar"


def expand_question(question: Column, killing: bool = True) -> Column:
    """The question and, a line each, the expansions that its wording calls for."""
    text = normalize(question)
    tokens = F.split(F.trim(text), r"\s+")
    two = F.array_contains(tokens, "2") | F.array_contains(tokens, "iki")
    absent = F.contains(text, F.lit("isci")) & text.rlike("ise gel|gelmez|gelmedi|devamsiz")
    lines = [question, F.when(two, F.lit(_TWO_DAYS)), F.when(absent, F.lit(_ABSENCE))]
    if killing:
        lines.append(F.when(F.contains(text, F.lit("oldur")), F.lit(_KILLING)))
    return F.concat_ws("\n", *lines)


def infinitive(title: Column) -> Column:
    """``… -me`` to ``-mek`` and ``… -ma`` to ``-mak``, lower-cased; empty for other endings."""
    text = F.trim(F.regexp_replace(title, r"\s+", " "))
    ending = F.right(normalize(text), F.lit(2))
    stem = F.substring(text, F.lit(1), F.length(text) - 2)
    return F.lower(F.when(ending == "me", F.concat(stem, F.lit("mek"))).when(ending == "ma", F.concat(stem, F.lit("mak"))).otherwise(""))


def synthetic_questions(law_name: Column, law_no: Column, title: Column, per_article: int, criminal_law: str = "5237") -> Column:
    """Up to ``per_article`` template questions for a titled article."""
    name, t = F.trim(F.coalesce(law_name, F.lit(""))), F.btrim(F.trim(F.coalesce(title, F.lit(""))), F.lit(":;-"))
    verb = infinitive(t)
    within = F.concat(name, F.lit(" kapsamında "), t)
    capital = F.concat(F.upper(F.left(verb, F.lit(1))), F.substring(verb, F.lit(2), F.length(verb)))
    crime = F.array(F.when(verb != "", F.concat(F.lit("Birini "), verb, F.lit(" suç mudur?"))), F.when(verb != "", F.concat(capital, F.lit(" suç mudur?"))), F.concat(t, F.lit(" suç mudur?")), F.concat(t, F.lit(" cezası nedir?")), F.concat(within, F.lit(" cezası nedir?")))
    rest = F.array(F.concat(within, F.lit(" nasıl düzenlenir?")), F.concat(t, F.lit(" nedir?")), F.concat(t, F.lit(" nasıl düzenlenir?")), F.concat(t, F.lit(" hakkında hangi hükümler vardır?")))
    every = F.concat(F.array(F.concat(within, F.lit(" nedir?"))), F.when(law_no == criminal_law, crime).otherwise(F.array().cast("array<string>")), rest)
    usable = (t != "") & ~normalize(t).isin(*GENERIC_TITLES)
    return F.when(usable, F.slice(F.filter(every, lambda q: q.isNotNull()), 1, per_article)).otherwise(F.array().cast("array<string>"))


def fallback_questions(law_name: Column, title: Column, per_article: int) -> Column:
    """Template questions of an article whose title is specific enough."""
    t = clean_title(title)
    name = F.coalesce(law_name, F.lit(""))
    every = F.array(F.concat(name, F.lit(" kapsamında "), t, F.lit(" nasıl düzenlenir?")), F.concat(name, F.lit(" kapsamında "), t, F.lit(" hakkında hangi hükümler vardır?")), F.concat(t, F.lit(" konusunda "), name, F.lit(" ne düzenler?")))
    usable = (F.length(t) >= 5) & ~normalize(t).isin(*GENERIC_TITLES) & is_useful_title(t)
    return F.when(usable, F.slice(every, 1, per_article)).otherwise(F.array().cast("array<string>"))
