"""Assurance of machine-learning data and models on Spark DataFrames."""
