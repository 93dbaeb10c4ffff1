"""Lodestone: a Spark-native engine for building, searching and maintaining a document knowledge base."""

__version__ = "0.1.0"
