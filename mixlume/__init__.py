"""Spark-native analytics for data quality, mixtures, scaling and evaluation."""
