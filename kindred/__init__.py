"""Spark-native search for similar short strings."""
