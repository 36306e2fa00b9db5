"""Column functions: text folding, coercions, display rounding and the reading of formulas."""
