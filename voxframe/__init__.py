"""Spark-first engine for quantitative image features and their metadata."""
