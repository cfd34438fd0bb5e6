"""Streams over all that is there give the rows of their batch forms."""

from folio.sources.tables import table
from folio.streaming import ledger as st


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def source(spark, sf):
    return st.stream(spark, sf, table(spark, sf, "events").schema, "events.parquet")


def test_ledger(spark, sf, tmp_path):
    got = st.drained(st.ledger(source(spark, sf)), "ledger", "complete", str(tmp_path))
    want = st.ledger(table(spark, sf, "events"))
    key = lambda df: sorted((r.user_id, r.calls, r.tokens, round(r.cost, 6), r.errors) for r in df.collect())
    assert key(got) == key(want)


def test_sessions(spark, sf, tmp_path):
    from folio.session import ship

    ship(spark)
    got = st.drained(st.session_stream(source(spark, sf)), "sessions", "update", str(tmp_path))
    assert rows(got.select("session", "state", "events", "illegal")) == rows(st.session_batch(table(spark, sf, "events")))


def test_resumed(spark, sf, tmp_path):
    for k in range(2):
        q = st.resumed(source(spark, sf), "event_id", str(tmp_path / "done"), str(tmp_path / f"c{k}"))
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "done")).count() == table(spark, sf, "events").count()
