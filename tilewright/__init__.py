"""A Spark-native engine for blocked linear algebra, featurisation and evaluation."""
