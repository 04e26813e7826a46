"""renderscope: Spark-native analytics for reviewed parallel texts."""

__version__ = "0.1.0"
