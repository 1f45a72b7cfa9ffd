"""Spark-native analytics for network-interference measurements."""
