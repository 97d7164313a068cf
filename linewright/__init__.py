"""Corpus audit engine on Spark: DataFrame in, DataFrame out."""
