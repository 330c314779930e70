"""lodestone: a PySpark-native engine for document retrieval and training-data preparation."""
