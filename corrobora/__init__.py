"""Spark-native reconciliation, belief and retrieval operators."""
