"""terrasift: a PySpark-native engine for terrain analytics."""

__version__ = "0.1.0"
