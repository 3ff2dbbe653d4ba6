"""tessera: a PySpark-native engine for associative-memory analytics."""
