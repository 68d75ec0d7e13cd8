"""Spark-first data preparation: clean, encode, split, pair, de-duplicate, score."""

__version__ = "0.1.0"
