"""threadloom: a PySpark-native analytics engine for conversational-community data."""

__version__ = "0.1.0"
