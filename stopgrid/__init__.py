"""Spark-native place resolution and search."""
