"""Operators: each takes DataFrames and gives a DataFrame, and starts no job of its own unless it says so."""
