"""Spark-native analytics over semi-structured place, document and cost data."""
