"""Spark-native document retrieval and text processing."""
