"""Operators on identifiers and texts for model training data. Nothing outside this package imports it."""
