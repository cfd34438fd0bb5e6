"""A corpus tree on any file system that Spark reads.

manifest.json lists the works; works/<work>/chapters/<chapter>/ holds meta.json, variants (*.md) and their paragraph
sidecars (*.paragraphs.json). Files are read by executors; the driver only asks whether a pattern has any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.errors import EngineError
from folio.operators.ingest import body_of, header_map
from folio.sources.files import exists, matches

#: The setting that names a root before all other candidates.
ROOT_CONF = "spark.folio.corpus.root"
META = "chapter_number long, chapter_slug string, layout string, default_variant string, variants array<struct<file: string, content_type: string, language: string>>"
PARAGRAPHS = "array<struct<id: string, pos: long, offset: long, text: string>>"


def root(spark: SparkSession, candidates: list[str]) -> str:
    """The first place with a manifest: the setting, then the candidates in order."""
    named = spark.conf.get(ROOT_CONF, None)
    for path in [*([named] if named else []), *candidates]:
        if exists(spark, f"{path}/manifest.json"):
            return path
    raise EngineError("CORPUS_NOT_FOUND", f"no manifest.json in {candidates}", f"set {ROOT_CONF}")


def manifest(spark: SparkSession, at: str) -> DataFrame:
    """A row for each work, with the manifest's columns."""
    return spark.read.json(f"{at}/manifest.json", multiLine=True).select(F.explode("works").alias("w")).select("w.*")


def _place(group: int) -> Column:
    return F.url_decode(F.regexp_extract("path", r"works/([^/]+)/chapters/([^/]+)/([^/]+)$", group))


def _files(spark: SparkSession, at: str, name: str) -> DataFrame:
    """(work, chapter, file, value): files of a name in all chapter folders; none where nothing matches."""
    glob = f"{at}/works/*/chapters/*/{name}"
    if matches(spark, glob):
        found = spark.read.text(glob, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    else:
        found = spark.createDataFrame([], "value string, path string")
    return found.select(_place(1).alias("work"), _place(2).alias("chapter"), _place(3).alias("file"), "value")


def metas(spark: SparkSession, at: str) -> DataFrame:
    """(work, chapter, chapter_number, chapter_slug, layout, default_variant, variants); folders without meta.json have no row."""
    return _files(spark, at, "meta.json").select("work", "chapter", F.from_json("value", META).alias("m")).select("work", "chapter", "m.*")


def variants(spark: SparkSession, at: str) -> DataFrame:
    """(work, chapter, file, header, body): the markdown files, header and body apart."""
    return _files(spark, at, "*.md").select("work", "chapter", "file", header_map(F.col("value")).alias("header"), body_of(F.col("value")).alias("body"))


def sidecars(spark: SparkSession, at: str) -> DataFrame:
    """(work, chapter, file, paragraphs) by the variant's file name; a sidecar is a list, or an object that holds one."""
    v = F.trim("value")
    listed = F.when(v.startswith("["), F.from_json(v, PARAGRAPHS)).otherwise(F.from_json(v, f"paragraphs {PARAGRAPHS}")["paragraphs"])
    return _files(spark, at, "*.paragraphs.json").select("work", "chapter", F.regexp_replace("file", r"\.paragraphs\.json$", ".md").alias("file"), listed.alias("paragraphs"))


def with_paragraphs(found: DataFrame, beside: DataFrame) -> DataFrame:
    """Variants with their paragraphs; without a sidecar, an empty list."""
    out = found.join(beside, ["work", "chapter", "file"], "left")
    return out.withColumn("paragraphs", F.coalesce("paragraphs", F.array().cast(PARAGRAPHS)))


def loaded(spark: SparkSession, at: str, only: str | None = None) -> DataFrame:
    """Chapters that have meta.json, a translation and its sidecar, of works in the manifest; others have no row."""
    works = manifest(spark, at).withColumnRenamed("slug", "work")
    if only is not None:
        works = works.where(F.col("work") == only)
    text = variants(spark, at).where("file = 'translation.md'")
    key = ["work", "chapter"]
    chapters = metas(spark, at).select(*key, "chapter_number", "chapter_slug", F.coalesce("layout", F.lit("prose")).alias("layout"))
    return works.select("work").join(chapters, "work").join(text.select(*key, "body"), key).join(sidecars(spark, at).where("file = 'translation.md'").select(*key, "paragraphs"), key)


def pool(spark: SparkSession, path: str) -> DataFrame:
    """A pool of records: one a line in *.jsonl, else one list."""
    return spark.read.json(path, multiLine=not path.endswith(".jsonl"))
