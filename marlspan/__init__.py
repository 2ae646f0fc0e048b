"""Spark-native analytics for evaluation data and 3-D trajectories."""
