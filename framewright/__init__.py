"""A Spark-native engine for asynchronous, episode-partitioned sensor and event streams."""
