"""A PySpark-native engine for annotated case-report forms."""
