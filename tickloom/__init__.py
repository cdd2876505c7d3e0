"""A PySpark-native engine for backtest research over time series."""
