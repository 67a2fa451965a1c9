"""Spark-native analytics over dense numeric fields and text corpora."""
