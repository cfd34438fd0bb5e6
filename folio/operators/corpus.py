"""Chapters and their variants as rows: defaults, reclassification, splitting by headings, plans, cards, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.errors import EngineError

# Languages whose originals are in Latin script, and those that have transliterations.
ROMAN = ("english", "french", "german", "old-english", "latin")
TRANSLITERATED = ("sanskrit", "urdu", "kawi")
#: The kinds of variants in the order in which a default is looked for.
KINDS = ("translation", "transliteration", "original")


def roman_source(language: Column, has_original: Column, has_transliteration: Column) -> Column:
    """(file, kind) of a chapter's text in Latin script; null without one."""
    made = lambda file, kind: F.struct(F.lit(file).alias("file"), F.lit(kind).alias("kind"))
    return F.when(language.isin(*ROMAN) & has_original, made("original.md", "native-roman")).when(language.isin(*TRANSLITERATED) & has_transliteration, made("transliteration.md", "transliteration"))


def indexable(variants: DataFrame) -> DataFrame:
    """The variants that a full-text index takes: translations only."""
    return variants.where("content_type = 'translation'")


def _preferred(kind: Column, place: Column) -> Column:
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), kind), F.lit(0))
    return F.struct(F.when(rank == 0, len(KINDS) + 1).otherwise(rank), place)


def defaults(variants: DataFrame) -> DataFrame:
    """Variants (work, chapter, place, file, content_type) with `default_file`: a translation, else a transliteration, else an original; the first of equals."""
    w = Window.partitionBy("work", "chapter")
    return variants.withColumn("default_file", F.min_by("file", _preferred(F.col("content_type"), F.col("place"))).over(w))


def flattened(variants: DataFrame) -> DataFrame:
    """(work, chapter, content_type, is_default): a row for each variant, with `default_file` given."""
    return variants.select("work", "chapter", "content_type", (F.col("file") == F.col("default_file")).alias("is_default"))


def reclassified(variants: DataFrame, actions: DataFrame) -> DataFrame:
    """Variants after actions (work, chapter, file, new_file; null deletes): renamed ones are transliterations.

    A chapter's default is looked for again only where an action meets it; a chapter that loses all variants has no row.
    """
    a = actions.select("work", "chapter", "file", "new_file", F.lit(True).alias("_hit"))
    w = Window.partitionBy("work", "chapter")
    met = variants.join(a, ["work", "chapter", "file"], "left").withColumn("_lost", F.max((F.col("_hit") & (F.col("file") == F.col("default_file"))).cast("int")).over(w))
    left = met.where("_hit is null or new_file is not null").select("work", "chapter", "place", F.coalesce("new_file", "file").alias("file"), F.when(F.col("_hit"), "transliteration").otherwise(F.col("content_type")).alias("content_type"), F.col("default_file").alias("_old"), "_lost")
    return defaults(left).withColumn("default_file", F.when(F.col("_lost") == 1, F.col("default_file")).otherwise(F.col("_old"))).drop("_old", "_lost")


def sections(bodies: DataFrame, rules: DataFrame) -> DataFrame:
    """(work, file, chapter, pos, title) over (work, file, body): headings by the rule of the file, else of the work, numbered in order.

    rules: (work, file, kind, depth, pattern, skip), file null for a work's default. 'prose-heading' takes headings of a
    depth that meet the pattern and not skip, where these are given; 'bracketed-section' takes lines in square brackets.
    A file without a rule has no sections.
    """
    fields = F.struct("kind", "depth", "pattern", "skip")
    own = rules.where("file is not null").select("work", "file", fields.alias("_own"))
    default = rules.where("file is null").select("work", fields.alias("_all"))
    ruled = bodies.join(own, ["work", "file"], "left").join(default, "work", "left").withColumn("r", F.coalesce("_own", "_all")).where("r is not null")
    lines = ruled.select("work", "file", "r", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    heading = lines.withColumn("title", F.trim(F.regexp_extract("line", r"^#+\s+(.+)$", 1))).withColumn("depth", F.length(F.regexp_extract("line", r"^(#+)\s", 1)))
    prose = (F.col("r.kind") == "prose-heading") & (F.col("title") != "") & (F.col("depth") == F.col("r.depth")) & F.coalesce(F.regexp_like("title", F.col("r.pattern")), F.lit(True)) & ~F.coalesce(F.regexp_like("title", F.col("r.skip")), F.lit(False))
    bracket = (F.col("r.kind") == "bracketed-section") & F.col("line").rlike(r"^\s*\[[^\]]+\]\s*$")
    found = heading.where(prose | bracket).withColumn("title", F.when(bracket, F.trim("line")).otherwise(F.col("title")))
    return found.select("work", "file", F.row_number().over(Window.partitionBy("work", "file").orderBy("pos")).cast("long").alias("chapter"), F.col("pos").cast("long").alias("pos"), "title")


def planned(folders: DataFrame, sliced: DataFrame) -> DataFrame:
    """(work, folder, chapters, n_chapters, n_variants) over folders (work, folder) and slices (work, file, chapter).

    A work that is to be split must have exactly one chapter folder; any other number is an error.
    """
    one = folders.groupBy("work").agg(F.countDistinct("folder").alias("n"), F.min("folder").alias("folder"))
    bad = F.raise_error(F.format_string("work %s: expected 1 chapter folder, found %d", "work", "n"))
    cut = sliced.groupBy("work").agg(F.sort_array(F.collect_set("chapter")).alias("chapters"), F.countDistinct("file").alias("n_variants"))
    none = F.array().cast("array<bigint>")
    out = one.withColumn("folder", F.when(F.col("n") == 1, F.col("folder")).otherwise(bad)).join(cut, "work", "left")
    return out.select("work", "folder", F.coalesce("chapters", none).alias("chapters"), F.size(F.coalesce("chapters", none)).cast("long").alias("n_chapters"), F.coalesce("n_variants", F.lit(0)).alias("n_variants"))


def manifest_after(manifest: DataFrame, plans: DataFrame) -> DataFrame:
    """The manifest with new totals of the works that were split: chapters, and chapters times variants with slices."""
    p = plans.select("work", F.col("n_chapters").alias("_c"), (F.col("n_chapters") * F.col("n_variants")).alias("_v"))
    out = manifest.join(p, "work", "left")
    new = {"total_logical_chapters": "_c", "total_variant_entries": "_v"}
    return out.select(*[F.coalesce(new[c], c).alias(c) if c in new else F.col(c) for c in manifest.columns])


def named_nearest(nearest: DataFrame, chapters: DataFrame, most: int = 3) -> DataFrame:
    """(key, rank, name, score): the first neighbours with the titles of their works; the key's own work name without one.

    nearest: (key, rank, target, score), target work/chapter; chapters: (target, title).
    """
    out = nearest.where(F.col("rank") <= most).join(chapters.select("target", "title"), "target", "left")
    return out.select("key", "rank", F.coalesce("title", F.element_at(F.split("target", "/"), 1)).alias("name"), "score")


def structural(works: DataFrame, slug: str) -> DataFrame:
    """(slug, tier, relation): works of the same author, else of the same era, else of the same genre."""
    mine = works.where(F.col("slug") == slug).select(*[F.col(c).alias(f"_{c}") for c in ("author", "era", "genre")])
    if mine.isEmpty():
        raise EngineError("WORK_NOT_FOUND", f"no work {slug}", "list_works names them")
    tiers = ("author", "era", "genre")
    relation = F.coalesce(*[F.when(F.col(c) == F.col(f"_{c}"), F.struct(F.lit(k + 2).alias("tier"), F.lit(f"same_{c}").alias("relation"))) for k, c in enumerate(tiers)])
    met = works.where(F.col("slug") != slug).join(mine, (F.col("author") == F.col("_author")) | (F.col("era") == F.col("_era")) | (F.col("genre") == F.col("_genre")))
    return met.withColumn("r", relation).select("slug", "r.tier", "r.relation")


def related(content: DataFrame, works: DataFrame, slug: str, limit: int = 5) -> DataFrame:
    """(slug, tier, relation, score): works near by content, a work once by its best link; then by author, era and genre.

    content: (slug, score), links of the chapter that is read.
    """
    near = content.where(F.col("slug") != slug).groupBy("slug").agg(F.max("score").alias("score")).select("slug", F.lit(1).alias("tier"), F.lit("content_similar").alias("relation"), "score")
    rest = structural(works, slug).join(near, "slug", "left_anti").withColumn("score", F.lit(None).cast("double"))
    return near.unionByName(rest).orderBy("tier", F.desc_nulls_last("score"), "slug").limit(limit)


def read_wiki(cards: DataFrame, works: DataFrame, slug: str, chapter: int | None = None, kind: str = "card") -> DataFrame:
    """(markdown, path) of a work's or a chapter's page; kind 'card' or 'full'. cards: (work, chapter, kind, markdown), chapter null for the work."""
    if works.where(F.col("slug") == slug).isEmpty():
        raise EngineError("WORK_NOT_FOUND", f"no work {slug}", "list_works names them")
    built = cards.where(F.col("work") == slug)
    if built.isEmpty():
        raise EngineError("WIKI_NOT_BUILT", f"no pages of {slug}", "build the cards")
    page = built.where(F.col("chapter").eqNullSafe(F.lit(chapter)) & (F.col("kind") == kind))
    if page.isEmpty():
        raise EngineError("WIKI_FILE_MISSING", f"{slug} has no {kind} of {'the work' if chapter is None else chapter}", "build the cards")
    name = F.coalesce(F.col("chapter").cast("string"), F.lit("_work"))
    return page.select("markdown", F.concat(F.lit(f"works/{slug}/wiki/"), name, F.lit(f".{kind}.md")).alias("path"))


def report(counts: DataFrame, title: str, column: str) -> DataFrame:
    """(markdown): a table of (column, n), most first, as one page; for columns with few values."""
    line = F.concat(F.lit("| "), F.coalesce(F.col(column).cast("string"), F.lit("-")), F.lit(" | "), F.col("n").cast("string"), F.lit(" |"))
    rows = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col(column).alias("v"), line.alias("line"))))
    body = F.array_join(F.transform(rows, lambda x: x["line"]), "\n")
    return counts.agg(F.concat(F.lit(f"# {title}\n\n| {column} | n |\n|---|---|\n"), body).alias("markdown"))
