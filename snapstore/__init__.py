"""Snapshot-versioned page store and query operators on Spark DataFrames."""
