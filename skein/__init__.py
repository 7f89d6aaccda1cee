"""Spark-native hybrid retrieval and corpus analytics."""
