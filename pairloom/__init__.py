"""Spark-first analytics for relative-value research on time series."""
