"""Spark-first analytics over versioned, content-addressed object catalogs."""

__version__ = "0.1.0"
