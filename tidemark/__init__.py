"""Serving and quality analytics for change logs, on Spark DataFrames."""
