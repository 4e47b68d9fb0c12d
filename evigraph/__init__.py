"""PySpark-native analytics over evidence graphs built from text and tables."""
