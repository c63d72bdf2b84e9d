"""A PySpark-native engine for robust quantification of long-format measurements."""
