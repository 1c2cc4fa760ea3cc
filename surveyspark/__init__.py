"""Spark-native engine for finding and judging predictors in survey data."""
