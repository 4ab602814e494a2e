"""Operators of the archive: functions from DataFrames to DataFrames."""
