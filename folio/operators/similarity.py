"""TF-IDF vectors, cosine links between documents, nearest works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions import text as tx
from folio.operators import blocks
from folio.session import stored

#: A link's least cosine, links of a document, tokens below which a document is left out.
LEAST_COSINE, LINKS, LEAST_TOKENS = 0.05, 5, 50
#: Least cosines that are tried first for works.
FLOORS = (0.9, 0.5)


def tokenized(docs: DataFrame, tokens: Column | None = None) -> DataFrame:
    return docs.select("doc_id", (tx.term_tokens(F.col("text")) if tokens is None else tokens).alias("tokens"))


def weights(docs: DataFrame) -> DataFrame:
    """(doc_id, term, w) over (doc_id, tokens): count times ln(N / df), without the terms of all documents.

    Terms that one document alone holds are weighed here, but cannot link; blocks keep them for the norms only.
    """
    tf = docs.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))  # of tf's columns, so that both sides of the join read one shuffle
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    return tf.join(df, "term").join(F.broadcast(n), F.col("df") < F.col("n")).select("doc_id", "term", "df", (F.col("tf") * F.log(F.col("n") / F.col("df"))).alias("w"))


def norms(w: DataFrame) -> DataFrame:
    return w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def cosine_pairs(w: DataFrame, least: float = LEAST_COSINE, size: int | None = None) -> DataFrame:
    """(a, b, cosine), a < b, of at least `least`, block by block. size: the documents, about; counted if not given."""
    return blocks.linked(w, least, size)


def cross_links(docs: DataFrame, least: float = LEAST_COSINE, top: int = LINKS, least_tokens: int = LEAST_TOKENS, source: str | None = None) -> DataFrame:
    """(doc_id, rank, target, score): each document's nearest, ties by the smaller id; short documents neither link nor count.

    source: the links of this work's documents only, among all.
    """
    kept = tokenized(docs).where(F.size("tokens") >= least_tokens)
    labels = None if source is None else labelled(docs)
    near = blocks.nearest(weights(kept), least, top, docs.count(), labels, source)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.round("cosine", 10)), "target"))
    return near.withColumn("rank", rank).where(F.col("rank") <= top).select("doc_id", "rank", "target", tx.round_half_up(F.col("cosine")).alias("score"))


def labelled(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").alias("label"))


def skipped(docs: DataFrame, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    return tokenized(docs).select("doc_id", F.size("tokens").cast("long").alias("tokens")).where(F.col("tokens") < least_tokens)


def nearest_works(docs: DataFrame, least: float = LEAST_COSINE, top: int = 4, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """(slug, other, score, rank): works by their best pair of documents.

    A higher least cosine is tried first, which meets far fewer pairs: if each work has `top` others beyond it, no pair below can count.
    """
    kept = tokenized(docs).where(F.size("tokens") >= least_tokens)
    labels = labelled(docs)
    met = blocks.Blocks(weights(kept), docs.count(), labels)
    works = labels.where("label is not null").select("label").distinct().count()
    rank = F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("score"), "other"))
    for floor in (*(x for x in FLOORS if x > least), least):
        found = blocks.labelled(met, floor)
        found = stored(found, "works") if floor > least else found
        best = found.groupBy("slug", "other").agg(F.round(F.max("cosine"), 4).alias("score"))
        beyond = best.where(F.col("score") > floor + 1e-4).groupBy("slug").count().where(F.col("count") >= min(top, works - 1))
        if floor > least and beyond.count() == works:
            break
    return best.withColumn("rank", rank).where(F.col("rank") <= top)
