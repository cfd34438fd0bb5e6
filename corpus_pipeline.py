"""The corpus pipeline: five stages over `documents`, each written as a table and read again by the next.

language ID -> n-gram Jaccard join -> benchmark decontamination -> PII -> BPE. Each stage works on all rows that the one before
it kept; the first four return the columns of documents, the last one the tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import bpe, decontaminate, langid, ngram_join, pii
from folio.llm.common import load, materialize, tune

#: A text is rejected when no learned language holds this share of its words.
LEAST_SHARE = 0.5


def _names(df: DataFrame) -> list[str]:
    return [f"`{c}`" for c in df.columns]


def _unused(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those in which no language holds half of the words; lang is what was predicted.

    Without a labelled row there is no language to reject by: all rows stay as they are.
    """
    tune(spark)
    model = langid.train(docs)
    if not model.labels:
        return docs
    plain = docs.withColumnsRenamed({c: _unused(docs, "_" + c) for c in ("lang_pred", "score") if c in docs.columns})
    found = langid.identify(plain, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    renamed = {c: p for c, p in zip(docs.columns, plain.columns, strict=True)}
    return found.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(f"`{p}`").alias(c) for c, p in renamed.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the row with the least doc_id stays; of equal texts of one doc_id, one row.

    It is rows that are kept or go, by doc_id and text: another text of the same doc_id stays unless its own group has a
    lesser row. Texts without a word are in no group; of equal ones of one doc_id, one stays. Rows without a doc_id belong
    to no group, and all stay. Empty tables stay empty.
    """
    tune(spark)
    doc, text = _unused(docs, "_doc"), _unused(docs, "_th")
    chosen = ngram_join.leaders(docs.select("doc_id", "text")).toDF(doc, text)
    named = docs.where("doc_id is not null").withColumn(doc, F.col("doc_id").cast("long")).withColumn(text, F.xxhash64("text"))
    kept = named.join(chosen, [doc, text], "left_semi").dropDuplicates([doc, text])
    return kept.select(*_names(docs)).unionByName(docs.where("doc_id is null"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents into which a benchmark item leaks, row by row: rows that share a doc_id are judged by their own texts.

    Null and empty texts hold no leak and stay; an empty benchmark drops nothing.
    """
    tune(spark)
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the text; n_chars, if there is one, follows the text. Every row stays; a null text stays null."""
    tune(spark)
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, ids_sha256, decoded_sha256: each whole text as tokens, with digests of ids and decoding.

    A row for each row, repeated ones included; a null text has no tokens. lang and source are left out where docs has none.
    """
    tune(spark)
    keep = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    return bpe.digest(docs.select(*keep, "text"), bpe.default_vocabulary(), keep=keep, out="ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("ngram_join", near_duplicates),
    ("decontaminate", decontaminated),
    ("pii", private),
    ("bpe", encoded),
]

#: No stage but the last can be given in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
