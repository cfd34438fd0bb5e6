"""Quotation linking: reply-ordered conversations without quotes, from DataFrame operations alone.

A line's quote level is the number of ">" that open it. Runs of lines of one level are passages; a passage is normalised
(lower case, runs of blanks as one) and hashed. Each message's own words (level 0), as a whole and paragraph by
paragraph, are hashed the same way, and kept once for each conversation and hash, at the earliest turn; so the join
from quoted passages to their originals meets one row, whatever is repeated. A message answers the message whose words it
quotes most of at the lowest level, an earlier turn of its conversation. Passages of under eight letters ("yes.") count where
they are a whole passage and the whole of an earlier message. Threads are followed to their first message by
pointer jumping, in as many rounds as the logarithm of the longest chain.

The result has a row for each message; ordered by conversation, thread and turn, a reply follows what it answers.

Null and empty text: an empty message, which quotes nothing and is quoted by none. Null conv_id or turn: no links. Rows
of one (conv_id, turn) keep their own texts; what one of them answers is decided for each row, and a link to that turn
leads to the turn. A quote of words that no earlier turn holds links with nothing, but is still taken out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import load, materialize, tune

#: A line of fewer letters is evidence of a reply only where it is a whole passage and a whole message.
SHORTEST = 8
OPENING = r"^((?:[ \t]*>)+)[ \t]?"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\x{A0}]+", " "))


def lines(text: Column) -> Column:
    """The lines of a message: level and body."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, OPENING, 1), "[^>]", "")).alias("level"), F.regexp_replace(x, OPENING, "").alias("body")))


def passages(parts: Column) -> Column:
    """Runs of lines of one level above 0, in order: level and body. A blank line of the message's own ends a run.

    Linear in the lines: a body holds no line break, so a line break and "#" can open a run, a line break and "." a line.
    """

    def marked(x: Column, i: Column) -> Column:
        body = F.concat(F.lit("\n."), x["body"])
        return F.when((i > 0) & (F.get(parts, i - 1)["level"] == x["level"]), body).otherwise(F.concat(F.lit("\n#"), x["level"].cast("string"), body))

    def run(piece: Column) -> Column:
        level = F.substring_index(piece, "\n.", 1)
        return F.struct(level.cast("int").alias("level"), F.replace(F.substr(piece, F.length(level) + 3), F.lit("\n."), F.lit("\n")).alias("body"))

    pieces = F.split(F.array_join(F.transform(parts, marked), ""), "\n#")
    return F.filter(F.transform(F.filter(pieces, lambda x: x != ""), run), lambda x: x["level"] > 0)


def hashed(whole: Column, parts: Column) -> Column:
    """Hashes and lengths of a normalised text, unless it is empty, and of those of its parts that are long enough."""

    def of(texts: Column, least: int) -> Column:
        return F.filter(F.transform(texts, lambda t: F.struct(F.xxhash64(normalised(t)).alias("hash"), F.length(normalised(t)).alias("size"))), lambda x: x["size"] >= least)

    return F.concat(of(F.array(whole), 1), of(parts, SHORTEST))


def parsed(messages: DataFrame) -> DataFrame:
    """messages with clean (own words), quote_levels, n_quotes, own (hashes) and quoted ("level hash size")."""
    m = messages.withColumn("_lines", lines(F.col("text")))
    own = F.transform(F.filter("_lines", lambda x: x["level"] == 0), lambda x: x["body"])
    m = m.withColumn("_passages", passages(F.col("_lines")))
    clean = F.regexp_replace(F.regexp_replace(F.array_join(own, "\n"), r"\n{3,}", "\n\n"), r"^[\s]+|[\s]+$", "")
    m = m.withColumn("clean", F.when(F.col("text").isNull(), F.lit("")).when(F.size("_passages") > 0, clean).otherwise(F.col("text")))
    paragraphs = F.split("clean", r"\n")
    m = m.withColumn("own", hashed(F.col("clean"), paragraphs))
    # as a whole, and line by line; told apart as strings, which are compared by hash where structs are compared pair by pair
    quoted = F.flatten(F.transform("_passages", lambda p: F.transform(hashed(p["body"], F.split(p["body"], r"\n")), lambda h: F.concat_ws(" ", p["level"], h["hash"], h["size"]))))
    return m.withColumn("quoted", F.array_distinct(quoted)).withColumn("quote_levels", F.coalesce(F.array_max(F.transform("_lines", lambda x: x["level"])), F.lit(0))).withColumn("n_quotes", F.size("_passages")).drop("_lines", "_passages")


def parents(m: DataFrame) -> DataFrame:
    """_row and parent_turn of the messages that quote an earlier turn of their conversation.

    Of the turns quoted at the lowest level, that of which most letters are quoted; then the latest.
    """
    known = m.where("conv_id is not null and turn is not null")
    originals = known.select("conv_id", "turn", F.explode("own").alias("o")).groupBy("conv_id", F.col("o.hash").alias("hash")).agg(F.min("turn").alias("source"))
    quotes = known.select("_row", "conv_id", "turn", F.explode("quoted").alias("q")).withColumn("q", F.split("q", " "))
    quotes = quotes.select("_row", "conv_id", "turn", *[F.col("q")[i].cast(kind).alias(name) for i, (name, kind) in enumerate((("level", "int"), ("hash", "long"), ("size", "int")))])
    met = quotes.join(originals, ["conv_id", "hash"]).where("source < turn")
    weighed = met.groupBy("_row", "level", "source").agg(F.sum("size").alias("letters"))
    best = weighed.groupBy("_row").agg(F.min(F.struct("level", -F.col("letters"), -F.col("source"), "source")).alias("b"))
    return best.select("_row", F.col("b.source").alias("parent_turn"))


def roots(links: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_turn, reply_depth) of the turns that answer one; links: (conv_id, turn, parent)."""
    now = materialize(links.groupBy("conv_id", "turn").agg(F.min("parent").alias("up")).withColumn("depth", F.lit(1).cast("long")), "threads")
    while True:
        above = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        step = now.join(above, ["conv_id", "up"], "left")
        if not step.where("further is not null").limit(1).count():
            return now.select("conv_id", "turn", F.col("up").alias("thread_turn"), F.col("depth").alias("reply_depth"))
        now = materialize(step.select("conv_id", "turn", F.coalesce("further", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "threads")


def thread(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), quote_levels, n_quotes, parent_turn, thread_turn, reply_depth."""
    rows = messages.select("conv_id", "turn", "role", "text")
    m = materialize(parsed(rows).withColumn("_row", F.monotonically_increasing_id()), "messages")
    up = materialize(parents(m), "parents")
    linked = m.select("_row", "conv_id", "turn").join(up, "_row")
    top = roots(linked.select("conv_id", "turn", F.col("parent_turn").alias("parent")))
    out = m.join(up, "_row", "left").join(top, ["conv_id", "turn"], "left")
    answers = F.col("parent_turn").isNotNull()
    return out.select(
        "conv_id", "turn", "role", F.col("clean").alias("text"), F.col("quote_levels").cast("long").alias("quote_levels"), F.col("n_quotes").cast("long").alias("n_quotes"), "parent_turn",
        F.when(answers, F.col("thread_turn")).otherwise(F.col("turn")).alias("thread_turn"), F.when(answers, F.col("reply_depth")).otherwise(F.lit(0)).alias("reply_depth"),
    )


def op8_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return thread(load(spark, sf_dir, "conversations")).orderBy("conv_id", "thread_turn", "turn")
