"""Scalar functions: columns in, column out."""
