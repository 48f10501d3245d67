"""weft: Spark-native analytics for reasoning traces and concept graphs."""

__version__ = "0.1.0"
