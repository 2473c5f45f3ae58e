"""A Spark-native engine for facts, provenance and retrieval analytics over documents."""
