"""Logical tables over the driver's data, and the registered queries with their SQL."""
