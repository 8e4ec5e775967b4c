"""Spark-native analytics over typed-edge graphs, time ranges and text."""
