"""termweave: a Spark-first engine that maps free text to vocabulary terms."""
