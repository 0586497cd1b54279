"""Spark-native engine that treats a music library as relational data."""
