"""Study-note retrieval and learning analytics as Spark DataFrame jobs."""
