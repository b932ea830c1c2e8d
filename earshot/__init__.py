"""Earshot: listening-history analytics and recommendation on Spark DataFrames."""
