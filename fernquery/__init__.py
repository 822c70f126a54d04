"""Fernquery: a Spark-native engine for hybrid retrieval over notes and documents."""
