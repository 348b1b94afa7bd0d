"""zonalis: a PySpark-native engine for zone-based spatial analytics."""
