"""folio: a Spark-first corpus analytics engine."""
