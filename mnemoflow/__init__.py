"""A PySpark-native engine for text memory analytics."""
