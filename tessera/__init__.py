"""Spark-native code-graph and hybrid-retrieval engine."""
