"""Spark-native operators for evaluating multi-step tool use."""
