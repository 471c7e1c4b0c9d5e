"""Quillwork: analytics over review and rating data, declared with Spark DataFrames."""

__version__ = "0.1.0"
