"""loomsearch: a Spark-first search and document-analytics engine."""
