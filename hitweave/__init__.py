"""Spark-native hit-stream analytics."""
