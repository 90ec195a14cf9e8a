"""Operators of the media catalog: each takes and returns DataFrames."""
