"""Operators for large text corpora, as used to prepare training data. Nothing else in the library imports this."""
