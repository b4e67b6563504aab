"""Spark-native evidence graph engine."""

__version__ = "0.1.0"
