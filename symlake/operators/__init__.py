"""Operators over fact tables; each takes DataFrames and returns a lazy DataFrame."""
