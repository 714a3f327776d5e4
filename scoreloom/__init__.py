"""A Spark-native engine for evaluating and ensembling scored text."""
