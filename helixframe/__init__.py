"""Spark-native analytics over sequence records and vector embeddings."""

__version__ = "0.1.0"
