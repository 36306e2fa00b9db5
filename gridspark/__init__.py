"""Deterministic analytics over spreadsheet-shaped data as Spark DataFrame plans."""
