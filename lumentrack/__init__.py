"""Spark-native analytics over time-lapse imaging tables: pixels, objects, tracks and measurements."""
