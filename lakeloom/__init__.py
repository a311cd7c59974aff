"""A PySpark-native engine for a warehouse SQL dialect, with query analysis and corpus operators."""
