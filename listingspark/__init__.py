"""Spark-native analytics for property-listing data."""
