"""barloom: a Spark-native engine for panels of time-ordered market data."""
