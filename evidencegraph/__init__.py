"""Spark-native analytics over multi-modal message evidence."""
