"""Spark-native analytics for translation-memory documents."""
