"""Spark-first analytics for noisy text records."""
