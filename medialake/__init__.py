"""A PySpark-native analytics library for very large media catalogs."""
