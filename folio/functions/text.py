"""Column functions over text: paragraph identity, tokenizers, n-grams, snippets, slugs, scripts, audits.

Everything here is a built-in expression that stays inside the JVM, but for `fold`, which no built-in covers.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from folio.functions.words import AUDIT_STOPWORDS, QUERY_STOPWORDS, TERM_STOPWORDS, TOKEN_STOPWORDS

#: Blanks: the ASCII ones, no-break space and byte-order mark.
BLANK = r"[ \t\n\x0B\f\r\x{A0}\x{FEFF}]"
FNV_START, FNV_PRIME, MASK32 = 2166136261, 16777619, 4294967295


def strip(text: Column) -> Column:
    """text without blanks at its ends."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def strip_left(text: Column) -> Column:
    return F.regexp_replace(text, f"\\A{BLANK}+", "")


def collapse(text: Column) -> Column:
    """text with runs of blanks as one blank."""
    return F.regexp_replace(text, f"{BLANK}+", " ")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the characters, as 8 hex digits. Characters beyond the basic plane count as one unit."""
    units = F.filter(F.split(text, ""), lambda c: c != "")
    code = F.aggregate(units, F.lit(FNV_START).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK32)))
    return F.lower(F.lpad(F.hex(code), 8, "0"))


def paragraph_id(text: Column) -> Column:
    """The id of a paragraph: p- and the first six digits of its hash. 24 bits are no key; ids may repeat."""
    return F.concat(F.lit("p-"), F.substring(fnv1a(strip(text)), 1, 6))


def paragraphs(body: Column, separator: str = r"\n\s*\n") -> Column:
    """The non-blank paragraphs of a body, trimmed."""
    return F.filter(F.transform(F.split(body, separator), strip), lambda p: p != "")


def with_offsets(parts: Column) -> Column:
    """Paragraphs with their offset in the body that joins them by a blank line: the running sum of length + 2."""
    empty = F.array().cast("array<struct<offset:bigint,text:string>>")
    start = F.struct(F.lit(0).cast("long").alias("next"), empty.alias("out"))
    return F.aggregate(
        parts, start,
        lambda a, p: F.struct((a["next"] + F.length(p) + 2).alias("next"), F.concat(a["out"], F.array(F.struct(a["next"].alias("offset"), p.alias("text")))).alias("out")),
        lambda a: a["out"],
    )


def in_list(token: Column, words: str) -> Column:
    return token.isin(words.split())


def without(tokens: Column, words: str) -> Column:
    return F.filter(tokens, lambda t: ~in_list(t, words))


def term_tokens(text: Column) -> Column:
    """Tokens for weighing: lower case, runs of a-z and apostrophes, three characters or more, no stopwords."""
    return F.filter(F.split(F.lower(text), "[^a-z']+"), lambda t: (F.length(t) >= 3) & ~in_list(t, TERM_STOPWORDS))


def search_tokens(text: Column) -> Column:
    """Distinct tokens of the search index."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z'][a-z']+"), F.lit(0))), lambda t: F.length(t) >= 3)


def language_tokens(text: Column, lang: Column) -> Column:
    """Tokens that keep hyphens and diacritics; stopwords by language. An unknown language is an error.

    lang: en, fr, de and ang have stopwords; es, sa, ur, kaw and la have none.
    """
    known = F.when(lang.isin("en", "fr", "de", "ang", "es", "sa", "ur", "kaw", "la"), lang).otherwise(F.raise_error(F.concat(F.lit("unknown language: "), F.coalesce(lang, F.lit("null")))))
    clean = F.lower(F.regexp_replace(text, r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}\x{FEFF}]", " "))
    parts = F.filter(F.split(clean, "[\\s\\x{A0},.;:()\\[\\]{}<>\"'!?\\x{2014}\\x{2013}\\x{2026}\\x{201C}\\x{201D}\\x{2018}\\x{2019}]+"), lambda t: F.length(t) >= 3)
    kept = F.when(F.lit(False), parts)
    for code, words in TOKEN_STOPWORDS.items():
        kept = kept.when(known == code, without(parts, words))
    return kept.when(known.isNotNull(), parts)


def ngrams(tokens: Column, n: int) -> Column:
    """Sliding runs of n tokens, joined by blanks; none if n < 1 or n exceeds their number.

    Shifted slices are zipped, so `tokens` is evaluated a few times for a row, not once for each run.
    """
    none = F.array().cast("array<string>")
    if n < 1:
        return none
    runs = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    out = F.slice(tokens, 1, runs)
    for j in range(1, n):
        out = F.zip_with(out, F.slice(tokens, j + 1, runs), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(tokens) >= n, out).otherwise(none)


def query_tokens(query: Column) -> Column:
    """(token, capital, place) of a query's distinct words: folded, three letters or more, no stopwords."""
    words = F.regexp_extract_all(query, F.lit("[A-Za-z][A-Za-z']+"), F.lit(0))
    items = F.transform(words, lambda w, i: F.struct(F.lower(w).alias("token"), ((i > 0) & F.substring(w, 1, 1).rlike("[A-Z]")).alias("capital"), i.alias("place")))
    fine = F.filter(items, lambda x: (F.length(x["token"]) >= 3) & ~in_list(x["token"], QUERY_STOPWORDS))
    return F.filter(fine, lambda x: ~F.exists(fine, lambda y: (y["token"] == x["token"]) & (y["place"] < x["place"])))


def offsets_of(text: Column, needle: Column) -> Column:
    """0-based offsets of the non-overlapping occurrences of a literal, left to right."""
    pieces = F.split(text, F.concat(F.lit(r"\Q"), F.regexp_replace(needle, r"\\E", r"\\E\\\\E\\Q"), F.lit(r"\E")), -1)
    start = F.struct(F.lit(0).cast("long").alias("next"), F.array().cast("array<bigint>").alias("out"))
    ends = F.aggregate(pieces, start, lambda a, p: F.struct((a["next"] + F.length(p) + F.length(needle)).alias("next"), F.concat(a["out"], F.array(a["next"] + F.length(p))).alias("out")), lambda a: a["out"])
    return F.slice(ends, 1, F.size(pieces) - 1)


def snippet(text: Column, offset: Column, size: Column, reach: int = 80) -> Column:
    """The surroundings of a hit: reach characters on either side, blanks collapsed, "..." where text was cut."""
    a = F.greatest(F.lit(0).cast("long"), offset - reach)
    b = F.least(F.length(text).cast("long"), offset + size + reach)
    body = collapse(strip(F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))))
    return F.concat(F.when(a > 0, "...").otherwise(""), body, F.when(b < F.length(text), "...").otherwise(""))


FOLDED = dict(zip("áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ", "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY", strict=True))


def slugify(text: Column) -> Column:
    """Lower-case ASCII words joined by dashes, at most 64 characters, cut at a dash beyond the 32nd if there is one."""
    s = F.translate(text, "".join(FOLDED), "".join(FOLDED.values()))
    for a, b in (("ß", "ss"), ("[æÆ]", "ae"), ("[œŒ]", "oe"), ("[ðÐ]", "d"), ("[þÞ]", "th")):
        s = F.regexp_replace(s, a, b)
    s = F.regexp_replace(F.regexp_replace(F.lower(s), "['\"`]", ""), "[^a-z0-9]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    head = F.substring(s, 1, 64)
    dash = F.lit(64) - F.locate("-", F.reverse(head))  # 0-based place of the last dash
    return F.when(F.length(s) <= 64, s).when((F.locate("-", head) > 0) & (dash > 32), head.substr(F.lit(1), dash)).otherwise(head)


def chapter_slug(number: Column, title: Column) -> Column:
    """NN-title, or NN for a title that says nothing."""
    n = F.lpad(number.cast("string"), 2, "0")
    n = F.when(F.length(number.cast("string")) > 2, number.cast("string")).otherwise(n)
    part = F.substring(slugify(title), 1, 50)
    return F.when(generic_title(title) | (part == ""), n).otherwise(F.concat(n, F.lit("-"), part))


def work_slug(author: Column, title: Column, uuid: Column) -> Column:
    parts = F.array(F.substring(slugify(author), 1, 24), F.substring(slugify(title), 1, 32), F.substring(F.regexp_replace(uuid, "-", ""), 1, 6))
    return F.array_join(F.filter(parts, lambda p: p != ""), "-")


@pandas_udf(StringType())
def fold(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without marks, lower case; no built-in decomposes."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if unicodedata.category(c)[0] != "M").lower())


SCRIPTS = (
    ("latin", r"[\x{41}-\x{7A}\x{C0}-\x{24F}]"),
    ("devanagari", r"[\x{900}-\x{97F}]"),
    ("arabic", r"[\x{600}-\x{6FF}\x{FB50}-\x{FDFF}]"),
    ("cjk", r"[\x{4E00}-\x{9FFF}]"),
)


def script(text: Column) -> Column:
    """The commonest script of the first 500 non-blank characters; the first in order wins a tie; `empty` without any."""
    sample = F.substring(F.regexp_replace(text, f"{BLANK}+", ""), 1, 500)
    counts = [(name, F.length(sample) - F.length(F.regexp_replace(sample, pattern, ""))) for name, pattern in SCRIPTS]
    rest = F.length(sample)
    for _, c in counts:
        rest = rest - c
    counts.append(("other", rest))
    top = F.greatest(*[c for _, c in counts])
    out = F.when(F.coalesce(F.length(sample), F.lit(0)) == 0, "empty")
    for name, c in counts:
        out = out.when(c == top, name)
    return out


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(strip(text), f"{BLANK}+"), lambda w: w != ""))


def generic_title(title: Column) -> Column:
    return title.isNull() | (title == "") | F.coalesce(strip(title).rlike(r"(?i)^(chapter|section|part|book|volume|verse)[ \t]+[0-9]+$"), F.lit(False))


def source_url(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?m)^Source:[ \t]*(https?://[^\s]+)", 1)
    return F.when(found != "", found)


def stopword_ratio(text: Column) -> Column:
    """The share of English function words among the words of the first 3,000 characters; 0 without words."""
    words = F.filter(F.split(F.lower(F.substring(text, 1, 3000)), "[^a-z']+"), lambda w: w != "")
    hits = F.size(F.filter(words, lambda w: in_list(w, AUDIT_STOPWORDS)))
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(hits / F.size(words))


def truncated(text: Column, limit: int = 80) -> Column:
    """A text of at most `limit` characters whole; else its first sentence, clause or words."""
    dot, comma = F.locate(". ", text) - 1, F.locate(", ", text) - 1
    head = F.substring(text, 1, limit + 1)
    space = F.when(F.locate(" ", head) > 0, F.lit(limit + 1) - F.locate(" ", F.reverse(head))).otherwise(F.lit(-1))
    cut = lambda n, tail: F.concat(text.substr(F.lit(1), n), F.lit(tail))
    return F.when(F.length(text) <= limit, text).when((dot > 0) & (dot < limit), cut(dot + 1, "")).when((comma > 0) & (comma < limit), cut(comma + 1, "...")).when(space > 0, cut(space, "...")).otherwise(cut(F.lit(limit), "..."))


def round_half_up(x: Column, places: int = 4) -> Column:
    """Rounding that takes halves up, also below zero."""
    return F.floor(x * float(10**places) + 0.5) / float(10**places)
