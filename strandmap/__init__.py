"""Spark-native analytics over single-cell chromosome contact maps."""
