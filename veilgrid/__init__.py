"""Spark-native analytics over frame-keyed detection data."""
