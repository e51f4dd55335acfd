"""Snapshot, content-store and corpus analytics on Spark DataFrames."""
