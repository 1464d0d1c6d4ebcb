"""Text retrieval and conversation analytics as Spark jobs."""
