"""Operators: functions from DataFrames and plans to DataFrames."""
