"""Query plans: functions from DataFrames to a DataFrame."""
