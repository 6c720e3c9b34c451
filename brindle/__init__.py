"""brindle: a Spark-native library of analytical and data-processing operators."""

__version__ = "0.1.0"
