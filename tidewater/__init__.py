"""Tidewater: a PySpark-native analytics engine for news-derived economic signals."""

__version__ = "0.1.0"
