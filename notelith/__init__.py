"""A Spark-native engine for batches of paginated supplier documents."""

__version__ = "0.1.0"
