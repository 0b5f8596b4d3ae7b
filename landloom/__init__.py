"""Spark-native land-cover analytics."""
