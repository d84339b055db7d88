"""Operators of the reconciliation: functions from DataFrames to DataFrames."""
