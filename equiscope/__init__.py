"""equiscope: a PySpark-native engine for factor ranking, backtests and panel statistics."""
