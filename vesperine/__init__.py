"""A Spark-native engine for compact vector retrieval and corpus preparation."""
