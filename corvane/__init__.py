"""A PySpark-native engine for hybrid retrieval, answer analytics and corpus preparation."""
