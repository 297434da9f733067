"""Spark-first knowledge retrieval and analytics engine."""
