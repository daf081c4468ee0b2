"""jobstrata: a Spark-native labour-market analytics library."""
