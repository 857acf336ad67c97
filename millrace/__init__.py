"""millrace: a Spark-native ingestion, text and search engine."""
