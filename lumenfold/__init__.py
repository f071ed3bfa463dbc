"""lumenfold: a Spark-native media-catalog and corpus engine."""

__version__ = "0.1.0"
