"""chorale: a Spark-native engine for messy media metadata and text corpora."""

__version__ = "0.1.0"
