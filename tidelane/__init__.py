"""Tidelane: a PySpark-native engine for timeline, operations and corpus data."""

__version__ = "0.1.0"
