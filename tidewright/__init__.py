"""Spark-native tabular preparation, feature, validation and drift analytics."""

__version__ = "0.1.0"
