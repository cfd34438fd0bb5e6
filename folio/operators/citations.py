"""Citation addresses, and links for paragraph ids inside HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def citation_url(work: Column, chapter: Column, variant: Column, ids: Column) -> Column:
    """/works/work/chapter/variant/, with one id as fragment, or several as query and the first as fragment."""
    part = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    base = F.concat(F.lit("/works/"), part(work), F.lit("/"), part(chapter), F.lit("/"), part(variant), F.lit("/"))
    good = F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda i: i.startswith("p-"))
    many = F.concat(base, F.lit("?paragraphs="), F.array_join(F.transform(good, part), ","), F.lit("#"), F.get(good, F.lit(0)))
    return F.when(F.size(good) == 0, base).when(F.size(good) == 1, F.concat(base, F.lit("#"), F.get(good, F.lit(0)))).otherwise(many)


def parsed_url(url: Column) -> Column:
    """(work, chapter, variant, ids, target) of a citation's address; null if it is none."""
    path = F.regexp_extract(url, r"^(?:[a-z]+://[^/]+)?([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    asked = F.regexp_extract(url, r"[?&]paragraphs=([^&#]*)", 1)
    ids = F.filter(F.transform(F.split(F.try_url_decode(asked), ","), F.trim), lambda i: i.startswith("p-"))
    mark = F.regexp_extract(url, r"#(.*)$", 1)
    target = F.when(mark.startswith("p-"), mark)
    found = F.when(F.size(ids) > 0, ids).when(target.isNotNull(), F.array(target)).otherwise(F.array().cast("array<string>"))
    return F.when((F.size(parts) == 4) & (F.get(parts, F.lit(0)) == "works"), F.struct(*[F.try_url_decode(F.get(parts, F.lit(k))).alias(n) for k, n in ((1, "work"), (2, "chapter"), (3, "variant"))], found.alias("ids"), target.alias("target")))


SKIPPED = r"(?is)<(pre|code|a|script|style)\b[^>]*>.*?</\1>|<[^>]+>"


def linkified(html: Column, base: str = "/p/") -> Column:
    """Paragraph ids in text become links; tags, and what stands in pre, code, a, script and style, stay as they are.

    The split regions are kept by cutting the text at them, linking between, and joining again.
    """
    regions = F.regexp_extract_all(html, F.lit(SKIPPED), F.lit(0))
    between = F.split(html, SKIPPED, -1)
    linked = F.transform(between, lambda t: F.regexp_replace(t, r"(?<![\w-])(p-[0-9a-f]{6})(?![\w-])", f'<a href="{base}$1">$1</a>'))
    return F.array_join(F.transform(linked, lambda t, i: F.concat(t, F.coalesce(F.get(regions, i), F.lit("")))), "")


def with_block_id(html: Column, block_id: Column) -> Column:
    """html whose first block tag has an id, unless it has one."""
    first = F.regexp_extract(html, r"(?s)^\s*(<[a-zA-Z][^>]*>)", 1)
    fits = (first != "") & ~first.rlike(r"\sid\s*=")
    named = F.regexp_replace(first, r"^<([a-zA-Z][\w-]*)", "<$1 id=\"ID\"")
    return F.when(fits, F.concat(F.replace(named, F.lit('id="ID"'), F.concat(F.lit('id="'), block_id, F.lit('"'))), html.substr(F.locate(">", html) + 1, F.length(html)))).otherwise(html)


def chapter_of(url: Column) -> Column:
    """(work, chapter) of an address of a chapter."""
    return F.struct(F.regexp_extract(url, r"/works/([^/]+)/", 1).alias("work"), F.regexp_extract(url, r"/works/[^/]+/0*(\d+)", 1).try_cast("int").alias("chapter"))
