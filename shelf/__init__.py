"""A PySpark-native retrieval engine for web articles."""
