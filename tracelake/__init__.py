"""Spark-native analytics for execution traces and text corpora."""
