"""Spark-native analytics over collections of notes and text documents."""
