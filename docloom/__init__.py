"""docloom: a PySpark-native engine for documentation pipelines and corpus preparation."""
