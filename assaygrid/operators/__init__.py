"""Operators: functions from DataFrames (or layers) to DataFrames."""
