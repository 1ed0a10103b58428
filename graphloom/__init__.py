"""Spark-native literature-graph analytics and training-data operators."""
