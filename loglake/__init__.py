"""loglake: a Spark-native tiered log analytics engine."""

__version__ = "0.1.0"
