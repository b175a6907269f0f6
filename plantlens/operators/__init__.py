"""Operators: functions from DataFrames to DataFrames, column names as arguments."""
