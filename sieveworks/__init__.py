"""Spark-first retrieval and text analytics."""
