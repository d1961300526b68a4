"""Spark-first analytics for small-molecule and bioactivity tables."""

__version__ = "0.1.0"
