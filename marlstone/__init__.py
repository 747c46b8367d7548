"""Spark-native cross-sectional equity research."""
