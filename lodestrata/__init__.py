"""lodestrata: a Spark-native engine for typed source graphs and nested records."""

__version__ = "0.1.0"
