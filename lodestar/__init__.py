"""Lodestar: a PySpark-native engine for matching records across noisy sources."""
