"""Spark-native reconciliation of two-sided tabular extracts."""
