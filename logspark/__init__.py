"""A PySpark-native engine for analysing log files."""
