"""Queries over the given tables, composed of the operators."""
