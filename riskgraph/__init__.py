"""Spark operators for ranking the components of a large transaction graph."""
