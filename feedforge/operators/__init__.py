"""Operators: functions from DataFrames to DataFrames, without state on the driver."""
