"""Versioned key-value and sketch analytics on Spark DataFrames."""
