"""Operators for building training data from packages, their items and a corpus of texts."""
