"""Relational and statistical operators: functions from DataFrames to DataFrames or columns."""
