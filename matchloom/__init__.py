"""A Spark-first record-linkage engine."""
