"""A PySpark-native engine for retrieval analytics over code and documents."""
