"""jobmill: a PySpark-native analytics engine for job-market data."""
