"""Streams: usage ledgers, session states, provider events. Each has a batch form that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

#: How late an event may come, and the length of a window. Windows are an extension of the ledger.
LATENESS, WINDOW = "1 hour", "1 day"


def normalised(events: DataFrame) -> DataFrame:
    """Provider events as session events: (session, ts, seq, kind, text)."""
    kind = F.when(F.col("event_type") == "view", "text").when(F.col("event_type") == "click", "tool").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").otherwise("start")
    return events.select(F.col("user_id").alias("session"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"), F.col("props").alias("text"))


def ledger(events: DataFrame) -> DataFrame:
    """Calls, tokens and cost for each case so far; also what a failed case has used."""
    k = F.get_json_object("props", "$.k").cast("long")
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.sum(k).alias("tokens"), F.sum("value").alias("cost"), F.count_if(F.col("event_type") == "error").alias("errors"))


def windowed(events: DataFrame, late: str = LATENESS, length: str = WINDOW) -> DataFrame:
    """Events and cost by window and type; the watermark lets go of closed windows."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def debounced(events: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """The last event of each burst: a session window closed by a pause."""
    s = events.withWatermark("ts", LATENESS).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("ts", "event_id")).alias("last"))
    return s.select("user_id", F.col("s.start").alias("start"), "n", F.col("last.event_id").alias("event_id"))


def newest(results: DataFrame, key: str, generation: str) -> DataFrame:
    """Results of a key's newest generation; those of older ones are stale."""
    top = results.groupBy(key).agg(F.max(generation).alias(generation))
    return results.join(top, [key, generation], "left_semi")


def arguments(deltas: DataFrame) -> DataFrame:
    """The arguments of each call, put together from its pieces in order."""
    return deltas.groupBy("call").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "delta"))), lambda x: x["delta"]), "").alias("arguments"))


#: Transitions of a session: (state, kind) -> state. Others are illegal; they are counted and change nothing.
STATES = {
    ("idle", "start"): "running", ("running", "text"): "running", ("running", "tool"): "tool", ("tool", "text"): "running", ("tool", "tool"): "tool",
    ("running", "done"): "done", ("tool", "done"): "done", ("running", "error"): "failed", ("tool", "error"): "failed", ("done", "start"): "running", ("failed", "start"): "running",
}
SESSION = "session long, state string, events long, illegal long"


def advance(state: str, kind: str) -> tuple[str, bool]:
    new = STATES.get((state, kind))
    return (new, True) if new else (state, False)


def sessions(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    """The state function of a session: its state, events and illegal events so far."""
    state, events, illegal = held.get if held.exists else ("idle", 0, 0)
    for kind in pd.concat(list(batches)).sort_values("seq")["kind"]:
        state, ok = advance(state, kind)
        events, illegal = events + 1, illegal + (not ok)
    held.update((state, events, illegal))
    yield pd.DataFrame({"session": [key[0]], "state": [state], "events": [events], "illegal": [illegal]})


def session_stream(events: DataFrame) -> DataFrame:
    return normalised(events).groupBy("session").applyInPandasWithState(sessions, SESSION, "state string, events long, illegal long", "update", GroupStateTimeout.NoTimeout)


def session_batch(events: DataFrame) -> DataFrame:
    """The same over a finished table: a fold over each session's kinds in order, without Python."""
    kinds = normalised(events).groupBy("session").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "kind"))), lambda x: x["kind"]).alias("kinds"))
    table = F.create_map(*[F.lit(x) for (s, k), n in STATES.items() for x in (f"{s} {k}", n)])
    start = F.struct(F.lit("idle").alias("state"), F.lit(0).cast("long").alias("illegal"))

    def step(a: Column, k: Column) -> Column:
        new = F.try_element_at(table, F.concat(a["state"], F.lit(" "), k))
        return F.struct(F.coalesce(new, a["state"]).alias("state"), (a["illegal"] + new.isNull().cast("long")).alias("illegal"))

    return kinds.select("session", F.aggregate("kinds", start, step).alias("r"), F.size("kinds").cast("long").alias("events")).select("session", "r.state", "events", "r.illegal")


def error_status(kind: Column) -> Column:
    """The outcome that an error's kind stands for."""
    return F.when(kind.isin("rate_limit", "quota"), "rate-limited").when(kind == "auth", "auth-failed").when(kind == "network", "offline").when(kind == "aborted", "stopped").when(kind == "context_length", "too-long").otherwise("failed")


def stream(spark: SparkSession, folder: str, schema, glob: str) -> DataFrame:
    """A file source over the tables of a folder that fit the pattern."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def drained(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there, into a table in memory; for tests and small results."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def resumed(df: DataFrame, key: str, done: str, checkpoint: str):
    """A stream that appends only rows whose key the table at `done` lacks: a rerun adds nothing twice."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(done)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            fresh = fresh.join(spark.read.parquet(done).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(done)

    return df.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def generations(events: DataFrame) -> DataFrame:
    """(user_id, event_type, n): each user's events of its newest day."""
    day = events.select("user_id", "event_type", F.to_date("ts").alias("day"))
    top = day.withColumn("newest", F.max("day").over(Window.partitionBy("user_id"))).where("day = newest")
    return top.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


def progress(done: Column, total: Column, seconds: Column) -> Column:
    """(elapsed_min, rate, remaining_min) of a batch; the rate is of a minute and counts a second at least."""
    elapsed = seconds / 60
    rate = done / F.greatest(elapsed, F.lit(1 / 60))
    return F.struct(elapsed.alias("elapsed_min"), rate.alias("rate"), ((total - done) / F.greatest(rate, F.lit(0.0001))).alias("remaining_min"))
