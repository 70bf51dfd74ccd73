"""Bounded-error array analytics on Spark DataFrames."""
