"""Spark-native analytics over sourced facts."""
