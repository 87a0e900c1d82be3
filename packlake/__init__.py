"""Spark-native analytics over packed, append-only file storage."""
