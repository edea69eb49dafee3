"""Spark-native image-feature and vigilance analytics."""
