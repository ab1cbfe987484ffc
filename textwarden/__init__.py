"""Checked-text analytics on Spark DataFrames."""
