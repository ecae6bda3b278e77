"""Clustering of point tables with Spark DataFrames."""
