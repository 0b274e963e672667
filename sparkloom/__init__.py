"""Spark-native analytics over recorded web front-end artifacts."""
