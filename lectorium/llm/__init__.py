"""Operators for training-text preparation. Nothing else in the library imports this subpackage."""
