"""Relational, recursive and retrieval operators: functions from DataFrames to DataFrames."""
