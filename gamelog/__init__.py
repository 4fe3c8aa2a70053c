"""Game-log analytics on Spark: features, forecasts and reports as DataFrame plans."""
