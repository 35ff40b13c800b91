"""Spark-native analytics over source-code corpora."""
