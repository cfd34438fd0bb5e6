"""Catalogue: works, chapters, passages, facets, related works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.errors import EngineError
from folio.functions import text as tx
from folio.sources.tables import paragraphs, works


def list_works(docs: DataFrame, *, language: str | None = None, slug_part: str | None = None, least_chapters: int | None = None) -> DataFrame:
    """Works by language (equal, whatever the case), part of the slug, and size; conditions are AND-ed."""
    out = works(docs)
    if language is not None:
        out = out.where(F.lower("language") == language.lower())
    if slug_part is not None:
        out = out.where(F.lower("slug").contains(slug_part.lower()))
    if least_chapters is not None:
        out = out.where(F.col("total_chapters") >= least_chapters)
    return out


def list_chapters(docs: DataFrame, slug: str) -> DataFrame:
    return work(docs, slug).groupBy(F.col("source").alias("slug"), F.col("doc_id").alias("chapter_number")).agg(F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("variants"), F.count(F.lit(1)).alias("n_variants"))


def metadata(docs: DataFrame, slug: str, chapters: int = 8) -> DataFrame:
    """(kind, name, n): the work's languages, and its first chapters with their characters."""
    own = work(docs, slug)
    langs = own.groupBy("lang").count().select(F.lit("language").alias("kind"), F.col("lang").alias("name"), F.col("count").alias("n"))
    first = own.orderBy("doc_id").limit(chapters).select(F.lit("chapter").alias("kind"), F.col("doc_id").cast("string").alias("name"), F.col("n_chars").alias("n"))
    return langs.unionByName(first)


def annotated(body: Column, separator: str = "\n") -> Column:
    """A body whose paragraphs bear their ids, a blank line between them."""
    return F.array_join(F.transform(tx.paragraphs(body, separator), lambda p: F.concat(F.lit("["), tx.paragraph_id(p), F.lit("] "), p)), "\n\n")


def work(docs: DataFrame, slug: str) -> DataFrame:
    """The documents of a work; an unknown one is an error."""
    own = docs.where(F.col("source") == slug)
    if own.select("source").isEmpty():
        raise EngineError("WORK_NOT_FOUND", f"no work {slug}", "list_works names them")
    return own


def read_chapter(docs: DataFrame, slug: str, chapter: int | None = None) -> DataFrame:
    own = work(docs, slug)
    if chapter is not None:
        own = own.where(F.col("doc_id") == chapter)
        if own.isEmpty():
            raise EngineError("CHAPTER_NOT_FOUND", f"{slug} has no chapter {chapter}", "list_chapters names them")
    return own.select("doc_id", "lang", annotated(F.col("text")).alias("body"))


def passage(docs: DataFrame, *, start: int | None = None, end: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Paragraphs by a range of places (both ends included) or by ids (`paragraph_id`); else the first eight."""
    p = paragraphs(docs).withColumn("paragraph_id", tx.paragraph_id(F.col("text")))
    if ids is not None:
        return p.join(ids.select("paragraph_id"), "paragraph_id", "left_semi").select("doc_id", "pos", "paragraph_id", "text")
    if start is not None or end is not None:
        if start is None or end is None or start < 0 or end < start:
            raise EngineError("BAD_QUERY", f"range {start}..{end}", "0 <= start <= end")
        return p.where(F.col("pos").between(start, end)).select("doc_id", "pos", "paragraph_id", "text")
    return p.where("pos < 8").select("doc_id", "pos", "paragraph_id", "text")


def related(links: DataFrame, docs: DataFrame, slug: str, limit: int = 5) -> DataFrame:
    """Works near a work: by content (best link of each), then of the same language; tiers fill up to the limit.

    links: (doc_id, rank, target, score).
    """
    by_doc = docs.select(F.col("doc_id"), F.col("source"))
    content = (
        links.join(by_doc, "doc_id").where(F.col("source") == slug).select("target", "score")
        .join(by_doc.withColumnsRenamed({"doc_id": "target", "source": "slug"}), "target").where(F.col("slug") != slug)
        .groupBy("slug").agg(F.max("score").alias("score")).withColumn("tier", F.lit(1))
    )
    w = works(docs)
    mine = w.where(F.col("slug") == slug).select("language")
    same = w.where(F.col("slug") != slug).join(mine, "language", "left_semi").select("slug", F.lit(0.0).alias("score"), F.lit(2).alias("tier"))
    merged = content.unionByName(same).groupBy("slug").agg(F.min(F.struct("tier", (-F.col("score")).alias("s"))).alias("b"))
    return merged.select("slug", F.col("b.tier").alias("tier"), (-F.col("b.s") + 0.0).alias("score")).orderBy("tier", F.desc("score"), "slug").limit(limit)


def facets(docs: DataFrame) -> DataFrame:
    """(facet, value, works, n_works, n_chapters)."""
    def one(name: str) -> DataFrame:
        return docs.groupBy(F.col(name).alias("value")).agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("works"), F.countDistinct("source").alias("n_works"), F.count(F.lit(1)).alias("n_chapters")).withColumn("facet", F.lit(name))

    return one("lang").unionByName(one("source"))


def variant_files(docs: DataFrame) -> DataFrame:
    """The file of each document within its work and language: lang.md, lang-2.md, ..."""
    n = F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id"))
    return docs.select("doc_id", "source", "lang", n.alias("n")).select("doc_id", F.when(F.col("n") == 1, F.concat("lang", F.lit(".md"))).otherwise(F.concat("lang", F.lit("-"), F.col("n").cast("string"), F.lit(".md"))).alias("file"))


def series(docs: DataFrame) -> DataFrame:
    """Works of a series: those whose slugs differ in their number's last digit only; others stand alone."""
    w = works(docs).select("slug")
    tens = F.regexp_extract("slug", r"^src(\d)\d$", 1)
    w = w.withColumn("series_id", F.when(tens != "", F.concat(F.lit("src-series-"), tens)).otherwise(F.concat(F.lit("solo-"), F.col("slug"))))
    size = w.groupBy("series_id").agg(F.count(F.lit(1)).alias("members"))
    return w.join(size, "series_id").select("slug", "series_id", (F.col("members") - 1).alias("siblings"))


def patched(base: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with the values that patches gives for its key; a null leaves the old value."""
    p = patches.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = base.join(p, key, "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])
