"""Terminology analytics on Spark: vocabularies matched, resolved, discovered and reviewed as DataFrames."""

__version__ = "0.1.0"
