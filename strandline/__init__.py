"""Spark-native analytics for irregular, multi-sensor observation data."""

__version__ = "0.1.0"
