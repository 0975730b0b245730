"""A PySpark-native engine for document retrieval, scoring and corpus preparation."""
