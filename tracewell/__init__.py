"""Spark-native behavioural and neural time-series analytics."""
