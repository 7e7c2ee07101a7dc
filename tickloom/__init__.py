"""Spark-native analytics over redundant market-data feeds."""
