"""Panel analytics on Spark: leak-free features, folds, metrics and forecasts for gridded series."""
