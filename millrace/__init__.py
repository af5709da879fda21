"""A PySpark-native engine for curating extraction datasets and judging extraction models."""
