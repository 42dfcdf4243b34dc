"""Bisulfite-sequencing analytics on Spark DataFrames."""
