"""Operators for large text and embedding corpora that feed model training.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
