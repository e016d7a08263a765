"""Catalogue-and-recommendation analytics on Spark DataFrames."""
