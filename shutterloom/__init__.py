"""Spark-native media-library analytics: dedup, capture time, archiving, culling."""
