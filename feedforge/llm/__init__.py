"""Operators for training-data pipelines; nothing else in the library imports this subpackage."""
