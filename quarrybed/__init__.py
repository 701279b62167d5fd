"""A PySpark-native analytics engine for digital-evidence records."""
