"""A PySpark-native engine for document evidence."""
