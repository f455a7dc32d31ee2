"""Aggregates, window frames, joins and vector search, as compositions of Spark's own operators."""
