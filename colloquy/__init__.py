"""Chat-log cleaning, sessions, chunks, retrieval and evaluation as Spark jobs."""
