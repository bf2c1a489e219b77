"""marketlab: Spark-first analytics for leakage-safe financial time series."""
