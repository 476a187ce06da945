"""PySpark-native analytics over a fact table and its entity registry."""
