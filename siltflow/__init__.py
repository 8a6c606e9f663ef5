"""Spark-native record pipelines."""
