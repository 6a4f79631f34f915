"""Readers, and the news data model derived from the given tables."""
