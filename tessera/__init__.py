"""A PySpark engine for hybrid retrieval, ranking and metadata analytics."""
