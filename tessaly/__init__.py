"""Spark-native mining, scoring and fusion of structured opinions, and corpus operations."""
