"""Spark-native engine for timed symbolic sequences.  Import the subpackages you need."""

__version__ = "0.1.0"
