"""Relational, text and graph operators: DataFrame(s) in, DataFrame out."""
