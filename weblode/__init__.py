"""Spark-native URL and endpoint analytics over text held in DataFrames."""
