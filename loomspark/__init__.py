"""Loomspark: a PySpark-native engine for dialogue memory, retrieval and evaluation."""
