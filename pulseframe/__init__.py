"""Spark-native analytics for event and signal sequences and the experiments run on them."""
