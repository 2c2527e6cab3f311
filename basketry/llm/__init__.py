"""Operators for training-text pipelines; nothing else in the library imports this package."""
