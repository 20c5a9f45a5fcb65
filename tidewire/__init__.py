"""Spark-native news and metrics analytics."""
