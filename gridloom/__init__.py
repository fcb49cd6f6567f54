"""Chunked N-dimensional arrays as DataFrames, with a Spark-first analytics engine on top."""

__version__ = "0.1.0"
