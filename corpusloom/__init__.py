"""Spark-native text corpus and retrieval engine."""
