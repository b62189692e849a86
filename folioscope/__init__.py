"""Spark-first analytics over research-paper metadata."""

__version__ = "0.1.0"
