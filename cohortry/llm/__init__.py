"""Operators for preparing language-model training text, built on Spark DataFrames."""
