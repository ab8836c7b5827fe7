"""Operators for large-scale training-data pipelines, all expressed as Spark jobs."""
