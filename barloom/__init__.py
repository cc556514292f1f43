"""A PySpark-native analytics engine for OHLCV bars."""
