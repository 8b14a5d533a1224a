"""A PySpark-native engine for cleaning, classifying, indexing, searching and ranking document collections."""
