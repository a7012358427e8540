"""Document-corpus and retrieval analytics as plain PySpark jobs."""
