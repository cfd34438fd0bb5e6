"""Queries of the streaming operators in their batch forms, with SQL; the tests hold the streams against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.sources.tables import table
from folio.streaming import ledger as st

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


KIND = "CASE event_type WHEN 'view' THEN 'text' WHEN 'click' THEN 'tool' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'start' END"


@query("o139_provider_events", f"SELECT user_id AS session, event_id AS seq, {KIND} AS kind FROM events")
def provider_events(spark: SparkSession, sf: str) -> DataFrame:
    return st.normalised(table(spark, sf, "events")).select("session", "seq", "kind")


NEXT = " ".join(f"WHEN s.state = '{a}' AND e.kind = '{k}' THEN '{b}'" for (a, k), b in st.STATES.items())


@query("o140_sessions", f"""WITH RECURSIVE e AS (SELECT user_id AS session, {KIND} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
s(session, k, state, illegal) AS (SELECT DISTINCT session, 0::BIGINT, 'idle', 0::BIGINT FROM e UNION ALL SELECT s.session, s.k + 1, CASE {NEXT} ELSE s.state END, s.illegal + CASE WHEN (CASE {NEXT} END) IS NULL THEN 1 ELSE 0 END FROM s JOIN e ON e.session = s.session AND e.k = s.k + 1)
SELECT session, state, k AS events, illegal FROM s QUALIFY row_number() OVER (PARTITION BY session ORDER BY k DESC) = 1""")
def sessions(spark: SparkSession, sf: str) -> DataFrame:
    return st.session_batch(table(spark, sf, "events"))


@query("o144_ledger", "SELECT user_id, count(*) AS calls, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS tokens, round(sum(value), 4) AS cost, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id")
def ledger(spark: SparkSession, sf: str) -> DataFrame:
    return st.ledger(table(spark, sf, "events")).withColumn("cost", F.round("cost", 4))


@query("x_windowed_ledger", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def windowed(spark: SparkSession, sf: str) -> DataFrame:
    return st.windowed(table(spark, sf, "events")).withColumn("value", F.round("value", 4))


@query("o143_debounced", "WITH x AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM x) SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) AS n, arg_max(event_id, (ts, event_id)) AS event_id FROM r GROUP BY user_id, run")
def debounced(spark: SparkSession, sf: str) -> DataFrame:
    return st.debounced(table(spark, sf, "events"))


@query("o142_newest_generation", "WITH d AS (SELECT user_id, event_type, ts::DATE AS day FROM events), m AS (SELECT user_id, max(day) AS day FROM d GROUP BY user_id) SELECT user_id, event_type, count(*) AS n FROM d JOIN m USING (user_id, day) GROUP BY ALL")
def newest(spark: SparkSession, sf: str) -> DataFrame:
    return st.generations(table(spark, sf, "events"))


@query("o141_arguments", "SELECT user_id AS call, string_agg(props, '' ORDER BY event_id) AS arguments FROM events GROUP BY user_id")
def arguments(spark: SparkSession, sf: str) -> DataFrame:
    return st.arguments(table(spark, sf, "events").select(F.col("user_id").alias("call"), F.col("event_id").alias("seq"), F.col("props").alias("delta")))


@query("o162_error_status", "SELECT * FROM (VALUES ('auth', 'auth-failed'), ('quota', 'rate-limited'), ('network', 'offline'), ('aborted', 'stopped'), ('context_length', 'too-long'), ('else', 'failed')) t(kind, status)")
def error_status(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(k,) for k in ("auth", "quota", "network", "aborted", "context_length", "else")], "kind string").select("kind", st.error_status(F.col("kind")).alias("status"))
