"""Spark-first analytics over time-stamped points in a two-dimensional field."""
