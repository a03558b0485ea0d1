"""Spark-native analytics of head-to-head contests, and of text corpora."""
