"""Tabular analytics and machine learning on Spark DataFrames."""

__version__ = "0.1.0"
