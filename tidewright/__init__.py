"""tidewright: a PySpark-native engine for pipeline analytics and relational, streaming and quality operators."""
