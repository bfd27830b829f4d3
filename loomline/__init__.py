"""loomline: a Spark-native engine for compressing and reconstructing time series."""
