"""Spark-native analytics for packaging-compliance data."""
