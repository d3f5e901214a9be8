"""Spark-native detection and redaction of sensitive text."""
