"""tidewell: a Spark-native engine for numeric time series."""
