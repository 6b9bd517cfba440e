"""A Spark-native engine for searching and analysing line-based text corpora."""
