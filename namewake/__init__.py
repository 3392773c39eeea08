"""Spark-native analytics over the market of internet names."""
