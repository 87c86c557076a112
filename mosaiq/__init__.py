"""A PySpark-native engine for late-interaction (multi-vector) retrieval."""
