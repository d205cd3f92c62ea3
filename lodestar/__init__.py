"""Functional-dependency discovery and data profiling on Spark DataFrames."""

__version__ = "0.1.0"
