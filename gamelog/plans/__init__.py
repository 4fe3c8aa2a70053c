"""Feature sets, the feature matrix, training sets, forecasts and reports."""
