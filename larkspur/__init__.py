"""larkspur: a PySpark-native analytics engine for text-heavy tables."""

__version__ = "0.1.0"
