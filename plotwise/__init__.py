"""Spark-native location analytics: DataFrame-in, DataFrame-out operators."""
