"""Data cleaning, data-quality flags and tabular answers as Spark DataFrames."""

__version__ = "0.1.0"
