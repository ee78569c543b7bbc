"""Operators: functions from DataFrame (plus column names) to DataFrame."""
