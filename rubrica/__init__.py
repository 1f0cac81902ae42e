"""Spark-native quality checks for nested assessment documents."""
