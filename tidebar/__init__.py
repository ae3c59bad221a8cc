"""Market time-series analytics on PySpark."""
