"""quercus: a PySpark-native engine for catalogue retrieval and data-quality work."""
