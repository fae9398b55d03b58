"""tessera: a PySpark-native engine for schema intelligence and query evaluation."""
