"""Spark-native thermal-graph analytics and corpus operators."""
