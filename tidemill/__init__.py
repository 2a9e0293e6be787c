"""A Spark-native engine for multi-horizon forecasting from long-format operational metrics."""
