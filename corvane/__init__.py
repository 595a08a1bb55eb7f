"""A Spark-native engine for retrieval, graph context, run analytics and training data."""
