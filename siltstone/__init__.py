"""Siltstone: a Spark-native engine for data-reduction analytics over collections of text and binary objects."""

__version__ = "0.1.0"
