"""All registered queries outside the training-data subpackage."""

from __future__ import annotations

from folio.plans import catalog_queries, corpus_queries, eval_queries, ingest_queries, stream_queries, text_queries

MODULES = (catalog_queries, text_queries, ingest_queries, corpus_queries, eval_queries, stream_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
