"""PySpark-native document-intelligence analytics."""
