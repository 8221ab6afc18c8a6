"""Spark-native analytics over the results of large automated-testing experiments."""
