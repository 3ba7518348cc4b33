"""Operators on DataFrames of timed text."""
