"""Detect, band and review analytics on Spark DataFrames."""
