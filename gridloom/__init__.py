"""Gridded and coordinate-labelled data analysis on Spark DataFrames."""
