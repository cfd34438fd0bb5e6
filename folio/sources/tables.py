"""Tables as the engine sees them: a work is a source, a chapter a document, a paragraph a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as tx


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def paragraphs(docs: DataFrame, separator: str = "\n") -> DataFrame:
    """doc_id, source, lang, pos, offset, text: the key is (doc_id, pos)."""
    parts = F.posexplode(tx.with_offsets(tx.paragraphs(F.col("text"), separator))).alias("pos", "p")
    return docs.select("doc_id", "source", "lang", parts).select("doc_id", "source", "lang", F.col("pos").cast("long").alias("pos"), F.col("p.offset").alias("offset"), F.col("p.text").alias("text"))


def works(docs: DataFrame) -> DataFrame:
    """slug, language (the commonest; the first by name of equals), total_chapters, total_chars, first_chapter."""
    by = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first"))
    return by.groupBy(F.col("source").alias("slug")).agg(F.min_by("lang", F.struct(-F.col("n"), "lang")).alias("language"), F.sum("n").alias("total_chapters"), F.sum("chars").alias("total_chars"), F.min("first").alias("first_chapter"))
