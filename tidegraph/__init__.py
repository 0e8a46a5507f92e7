"""A PySpark-native engine for time-aware computation graphs."""
