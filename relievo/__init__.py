"""Spark-native terrain engine."""
