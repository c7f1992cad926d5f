"""Document-retrieval analytics as batch and streaming Spark jobs."""
