"""Spark-native analytics over heterogeneous document collections."""
