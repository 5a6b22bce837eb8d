"""Spark-native analytics over conversation logs: sources, operators, functions, plans, streaming."""
