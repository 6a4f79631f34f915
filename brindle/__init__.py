"""Brindle: a Spark-native analytics engine for document and news collections."""

__version__ = "0.1.0"
