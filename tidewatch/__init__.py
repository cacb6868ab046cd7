"""Spark-native analytics over network-flow tables."""
