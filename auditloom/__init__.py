"""Spark-native audit, search and risk analytics over DataFrames and Structured Streaming."""
