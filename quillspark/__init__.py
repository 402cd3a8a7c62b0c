"""Spark-native record analytics and training-data preparation."""
