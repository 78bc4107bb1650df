"""Gridded-data and particle analytics on Spark DataFrames."""
