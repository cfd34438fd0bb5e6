"""What sets a chapter or work apart: n-grams, pointwise mutual information, unique phrases, stylometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions import text as tx
from folio.sources.tables import paragraphs

#: Terms of a group that pair with each other at most.
VOCABULARY = 500


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, tokens by language."""
    return docs.select("doc_id", "source", "lang", tx.language_tokens(F.col("text"), F.col("lang")).alias("tokens"))


def top_ngrams(toks: DataFrame, n: int, top: int, key: str = "doc_id") -> DataFrame:
    """(key, gram, uses, frequency, rank): by count, then by first place in the text. frequency is the share of all grams."""
    grams = toks.select(key, F.posexplode(tx.ngrams(F.col("tokens"), n)).alias("place", "gram"))
    counts = grams.groupBy(key, "gram").agg(F.count(F.lit(1)).alias("uses"), F.min("place").alias("first"))
    w = Window.partitionBy(key)
    rank = F.row_number().over(w.orderBy(F.desc("uses"), "first"))
    total = F.sum("uses").over(w)
    return counts.withColumn("frequency", F.round(F.col("uses") / total, 6)).withColumn("rank", rank).where(F.col("rank") <= top).select(key, "gram", "uses", "frequency", "rank")


def unique_phrases(toks: DataFrame, top: int = 8, n: int = 3) -> DataFrame:
    """(source, gram, uses, rank): a work's commonest n-grams that no other work has."""
    grams = toks.select("source", "doc_id", F.posexplode(tx.ngrams(F.col("tokens"), n)).alias("place", "gram"))
    per = grams.groupBy("source", "gram").agg(F.count(F.lit(1)).alias("uses"), F.min(F.struct("doc_id", "place")).alias("first"))
    others = per.groupBy("gram").agg(F.countDistinct("source").alias("works"))
    own = per.join(others.where("works = 1"), "gram")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("uses"), "first"))
    return own.withColumn("rank", rank).where(F.col("rank") <= top).select("source", "gram", "uses", "rank")


def npmi(groups: DataFrame, least_joint: int = 2, vocabulary: int = VOCABULARY) -> DataFrame:
    """(key, a, b, joint, npmi) over (key, unit, tokens): terms that share units, a < b.

    A key pairs its `vocabulary` commonest terms at most: that bound is the operator's own. Pairs of every unit, whose
    information is undefined, are left out; values are held to [-1, 1].
    """
    held = groups.select("key", "unit", F.explode(F.array_distinct("tokens")).alias("term"))
    df = held.groupBy("key", "term").agg(F.count(F.lit(1)).alias("df"))
    best = df.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("df"), "term"))).where((F.col("r") <= vocabulary) & (F.col("df") >= least_joint)).drop("r")
    kept = held.join(best, ["key", "term"])
    packed = kept.groupBy("key", "unit").agg(F.sort_array(F.collect_list(F.struct("term", "df"))).alias("t"))
    pairs = packed.select("key", F.explode(F.flatten(F.transform("t", lambda x, i: F.transform(F.slice(F.col("t"), i + 2, F.greatest(F.size("t") - i - 1, F.lit(0))), lambda y: F.struct(x["term"].alias("a"), y["term"].alias("b"), x["df"].alias("da"), y["df"].alias("db")))))).alias("p"))
    joint = pairs.groupBy("key", "p.a", "p.b", "p.da", "p.db").agg(F.count(F.lit(1)).alias("joint")).where(F.col("joint") >= least_joint)
    units = groups.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    x = joint.join(units, "key")
    bits = F.log(F.col("joint") * F.col("n") / (F.col("da") * F.col("db")))
    scale = -F.log(F.col("joint") / F.col("n"))
    return x.where(F.col("joint") < F.col("n")).select("key", "a", "b", "joint", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), bits / scale)).alias("npmi"))


def vocabulary_ratios(toks: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_types, ttr, hapax): types per token, and the share of types used once."""
    uses = toks.select("doc_id", F.explode("tokens").alias("t")).groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("n"))
    per = uses.groupBy("doc_id").agg(F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_types"), F.count_if(F.col("n") == 1).alias("once"))
    return per.select("doc_id", "n_tokens", "n_types", F.round(F.col("n_types") / F.col("n_tokens"), 6).alias("ttr"), F.round(F.col("once") / F.col("n_types"), 6).alias("hapax"))


def burrows_delta(toks: DataFrame, top: int = 100) -> DataFrame:
    """(doc_id, delta): mean |z| of a chapter's frequencies of its siblings' commonest words against these siblings.

    Siblings are the other chapters of the work. Their sums are the work's less the chapter's own, so no chapter is
    compared pair by pair. Absent words have frequency 0; words that do not vary are left out; 0 without siblings.

    A chapter's own words sink among its siblings' words, no other word rises. So a chapter of k different words has its
    `top` among the first k + `top` of the work's words, and meets those only: rows grow with the texts' words.
    """
    sized = toks.select("source", "doc_id", F.explode("tokens").alias("t"), F.size("tokens").alias("size"))
    f = sized.groupBy("source", "doc_id", "t").agg((F.count(F.lit(1)) / F.max("size")).alias("f"))
    work = f.groupBy("source", "t").agg(F.sum("f").alias("s"), F.sum(F.col("f") * F.col("f")).alias("q"))
    work = work.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc(F.round("s", 12)), "t")))
    members = toks.groupBy("source").agg(F.count(F.lit(1)).alias("m"))
    chapters = toks.select("source", "doc_id")
    reach = toks.select("source", "doc_id", (F.greatest(F.size(F.array_distinct("tokens")), F.lit(0)) + top).alias("k"))
    places = reach.join(members, "source").where("m > 1").select("source", "doc_id", "m", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("place"))
    each = places.join(work, ["source", "place"]).join(f, ["source", "doc_id", "t"], "left").na.fill(0.0, ["f"])
    each = each.withColumn("rest", F.col("s") - F.col("f")).where("rest > 1e-15")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.round("rest", 12)), "t"))
    best = each.withColumn("r", rank).where(F.col("r") <= top)
    mean = F.col("rest") / (F.col("m") - 1)
    var = (F.col("q") - F.col("f") * F.col("f")) / (F.col("m") - 1) - mean * mean
    z = best.withColumn("sd", F.sqrt(F.greatest(var, F.lit(0.0)))).where("sd > 1e-9").withColumn("z", F.abs((F.col("f") - mean) / F.col("sd")))
    got = z.groupBy("doc_id").agg(F.round(F.avg("z"), 4).alias("delta"))
    return chapters.join(got, "doc_id", "left").select("doc_id", F.coalesce("delta", F.lit(0.0)).alias("delta"))


def paragraph_units(docs: DataFrame) -> DataFrame:
    """(key, unit, tokens): the paragraphs of each document."""
    return paragraphs(docs).select(F.col("doc_id").alias("key"), F.col("pos").alias("unit"), tx.language_tokens(F.col("text"), F.col("lang")).alias("tokens"))
