"""A Spark-native engine for code facts and corpora."""
