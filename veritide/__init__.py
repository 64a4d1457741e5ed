"""Declarative data-quality analytics on Spark DataFrames."""
