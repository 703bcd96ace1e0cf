"""Spark-native analytics for sensitive data in tables, documents and page layouts."""
