"""Spark-first analytics for topic-based publish/subscribe data."""
