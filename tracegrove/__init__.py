"""Spark-native retrieval and audit analytics engine."""
