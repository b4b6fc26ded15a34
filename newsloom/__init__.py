"""A PySpark-native analytics engine for evidence-backed information streams."""
