"""Search: literal hits with snippets and paragraphs, the fallback by distinctive tokens, and query strategies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.errors import EngineError
from folio.functions import text as tx
from folio.sources.tables import paragraphs


#: Needles without an inner word that are tried on each text as constants.
SHORT_NEEDLES = 1000


def literal_hits(docs: DataFrame, needle: Column, lang: str | None = "en", ignore_case: bool = True) -> DataFrame:
    """doc_id, source, offset, snippet, paragraph_id of every non-overlapping occurrence of a literal.

    The scope is pushed to the scan. The paragraph is the first whose span, two characters longer than its text, holds the
    offset; it is found inside the row, so the range join needs no shuffle.
    """
    d = docs if lang is None else docs.where(F.col("lang") == lang)
    hay, n = (F.lower("text"), F.lower(needle)) if ignore_case else (F.col("text"), needle)
    d = d.where(F.contains(hay, n) & (F.length(n) > 0)).select("doc_id", "source", "text", F.explode(tx.offsets_of(hay, n)).alias("offset"), F.length(n).alias("size"))
    parts = tx.with_offsets(tx.paragraphs(F.col("text"), "\n"))
    inside = F.get(F.filter(parts, lambda p: (p["offset"] <= F.col("offset")) & (F.col("offset") < p["offset"] + F.length(p["text"]) + 2)), F.lit(0))
    return d.select("doc_id", "source", "offset", tx.snippet(F.col("text"), F.col("offset"), F.col("size")).alias("snippet"), F.when(inside.isNotNull(), tx.paragraph_id(inside["text"])).alias("paragraph_id"))


def search(docs: DataFrame, query: str, limit: int = 30, lang: str | None = "en", source: str | None = None, ignore_case: bool = True) -> DataFrame:
    """The first hits in the order of works, chapters and offsets. A blank query has none."""
    d = docs.where(F.col("source") == source) if source is not None else docs
    if not query.strip():
        d = d.where(F.lit(False))
    return literal_hits(d, F.lit(query), lang, ignore_case).orderBy("source", "doc_id", "offset").limit(limit)


def document_frequency(docs: DataFrame) -> DataFrame:
    """(token, df) over the documents given; a token counts once in each."""
    return docs.select("doc_id", F.explode(tx.search_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def distinctive(docs: DataFrame, queries: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, token, idf, rank): the most distinctive tokens of each query; capitalised words inside it first, then rare ones.

    A token that no document holds has a frequency of one half.
    """
    total = docs.agg(F.count(F.lit(1)).alias("_n"))
    asked = queries.select("query_id", F.inline(tx.query_tokens(F.col("query"))))
    scored = asked.join(document_frequency(docs), "token", "left").join(F.broadcast(total), F.lit(True), "left")
    scored = scored.withColumn("idf", F.log((F.greatest(F.col("_n"), F.lit(1)) + 1) / (F.coalesce(F.col("df").cast("double"), F.lit(0.5)) + 0.5)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("capital"), F.desc("idf"), "place"))
    return scored.select("query_id", "token", "idf", rank.alias("rank")).where(F.col("rank") <= most)


def containing(docs: DataFrame, needles: DataFrame, key: str) -> DataFrame:
    """(key, doc_id): whose needle stands in the document's text, case aside.

    A needle's inner words stand between blanks in every text that holds it: documents are met by the longest one, then
    compared as literals. Needles without an inner word are tried on each text in one pass, as constants; they are counted
    first, and more than SHORT_NEEDLES of them are an error. Null or empty needles are in no text.
    """
    low = needles.where("needle <> ''").select(key, F.lower("needle").alias("needle")).withColumn("words", F.split("needle", r"\s+"))
    inner = F.slice("words", 2, F.greatest(F.size("words") - 2, F.lit(0)))
    seed = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    low = low.withColumn("word", seed)
    texts = docs.select("doc_id", F.lower("text").alias("text"))
    words = texts.select("doc_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word"))
    met = words.join(low.where("word is not null").select(key, "word", "needle"), "word").select(key, "needle", "doc_id")
    out = met.join(texts, "doc_id").where(F.contains("text", "needle")).select(key, "doc_id")
    short = low.where("word is null").select(key, "needle")
    few = [r[0] for r in short.select("needle").distinct().limit(SHORT_NEEDLES + 1).collect()]
    if len(few) > SHORT_NEEDLES:
        raise EngineError("BAD_QUERY", f"more than {SHORT_NEEDLES} needles of one or two words", "ask for them in parts")
    if few:
        held = F.filter(F.array(*map(F.lit, few)), lambda x: F.contains(F.col("text"), x))
        out = out.unionByName(texts.select("doc_id", F.explode(held).alias("needle")).join(short, "needle").select(key, "doc_id"))
    return out


def fallback(docs: DataFrame, queries: DataFrame, limit: int = 30, lang: str = "en") -> DataFrame:
    """(query_id, doc_id, tokens, hits, rank) for queries of more than five words without a literal hit.

    One plan: literal hits gate the second branch by an anti join. Documents are ranked by how many of the query's
    distinctive tokens begin a word in them, then by the number of such words.
    """
    d = docs.where(F.col("lang") == lang)
    long = queries.where(F.size(F.filter(F.split(F.trim("query"), r"\s+"), lambda w: w != "")) > 5)
    found = containing(d, long.select("query_id", F.col("query").alias("needle")), "query_id").select("query_id")
    asked = distinctive(d, long.join(found, "query_id", "left_anti"))
    starts = d.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9_]+"), F.lit(0))).alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    prefixes = asked.select("query_id", "token").withColumn("head", F.substring("token", 1, 3))
    met = starts.withColumn("head", F.substring("word", 1, 3)).join(prefixes, "head").where(F.startswith("word", "token"))
    per = met.groupBy("query_id", "doc_id").agg(F.countDistinct("token").alias("tokens"), F.sum("n").alias("hits"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("tokens"), F.desc("hits"), "doc_id"))
    return per.withColumn("rank", rank).where(F.col("rank") <= limit)


def strategies(raw: str) -> list[str]:
    """The queries to try in order for what a user typed: a comma separates alternatives; then each again with prefixes."""
    groups = [g.split() for g in re.split(r"\s*,\s*", raw.strip()) if g.split()]
    exact = [" ".join(g) for g in groups]
    wild = [" ".join(t if t.endswith("*") or t.startswith('"') else t + "*" for t in g) for g in groups]
    return exact + [w for w, e in zip(wild, exact, strict=True) if w != e]


def matches(text: Column, strategy: str) -> Column:
    """Whether a text holds all of a strategy's words: whole ones, or beginnings where they end in "*"."""
    out = F.lit(True)
    for t in strategy.lower().replace('"', "").split():
        word = re.escape(t.rstrip("*"))
        out = out & F.lower(text).rlike(rf"(^|[^a-z0-9_]){word}" + ("" if t.endswith("*") else r"($|[^a-z0-9_])"))
    return out


def any_of(docs: DataFrame, raw: str) -> DataFrame:
    """(doc_id, branch): documents that match an alternative; the first alternative that matches counts."""
    options = strategies(raw)
    branch = F.coalesce(*[F.when(matches(F.col("text"), s), F.lit(k)) for k, s in enumerate(options)]) if options else F.lit(None).cast("int")
    return docs.select("doc_id", branch.alias("branch")).where(F.col("branch").isNotNull())


def ranked(docs: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """(doc_id, score): documents with all words of a query, by the sum of term frequency times inverse frequency.

    An approximation of a full-text index without its stemming. limit is held to 1..25.
    """
    words = [w for w in re.findall("[a-z'][a-z']+", query.lower()) if len(w) >= 3]
    tokens = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z'][a-z']+"), F.lit(0))).alias("token")).where(F.col("token").isin(words))
    tf = tokens.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    scored = tf.join(F.broadcast(df), "token").join(F.broadcast(total), F.lit(True), "left")
    per = scored.groupBy("doc_id").agg(F.count(F.lit(1)).alias("held"), F.sum(F.col("tf") * F.log(1 + F.col("n") / F.col("df"))).alias("score"))
    return per.where(F.col("held") == len(set(words))).select("doc_id", F.round("score", 4).alias("score")).orderBy(F.desc("score"), "doc_id").limit(max(1, min(25, limit)))


def paragraph_index(docs: DataFrame) -> DataFrame:
    """(paragraph_id, doc_id, pos): the first paragraph of each id."""
    p = paragraphs(docs).withColumn("paragraph_id", tx.paragraph_id(F.col("text")))
    return p.groupBy("paragraph_id").agg(F.min(F.struct("doc_id", "pos")).alias("k")).select("paragraph_id", "k.doc_id", "k.pos")
