"""Operators for preparing text collections as training data; nothing else in the library imports this package."""
