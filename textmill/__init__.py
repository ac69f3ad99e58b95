"""textmill: a PySpark-native engine that prepares, audits and packs language-model training data."""
