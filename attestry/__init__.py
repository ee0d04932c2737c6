"""Spark-native analytics over scoped, evidence-backed statements and the documents they come from."""
