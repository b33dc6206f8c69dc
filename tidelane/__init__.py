"""tidelane: a PySpark-native engine for interval records over long sensor and event streams."""
