"""Recommender data preparation and evaluation on Spark DataFrames."""
