"""A PySpark-native multi-dimensional retrieval and analytics engine."""
