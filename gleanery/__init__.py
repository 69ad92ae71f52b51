"""Context retrieval over many projects and tasks, as PySpark jobs."""
