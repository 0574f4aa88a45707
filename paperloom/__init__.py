"""Spark-native document processing and retrieval."""
