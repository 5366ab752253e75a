"""citeloom: a Spark-native engine for building and scoring cited question sets."""
