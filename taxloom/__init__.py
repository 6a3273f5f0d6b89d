"""Purchase-compliance analytics on Spark DataFrames: rules, reconciliation, credit decisions, risk and forecasts."""
