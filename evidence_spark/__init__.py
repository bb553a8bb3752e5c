"""Evidence retrieval and question-set analytics as Spark DataFrame jobs."""
