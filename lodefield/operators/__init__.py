"""Operators: functions from DataFrames to DataFrames, grouped by subject."""
