"""vellum: a PySpark-native analytics engine for corpora of ordered, annotated, versioned text blocks."""
