"""A Spark-native text retrieval, alignment and timeline engine."""
