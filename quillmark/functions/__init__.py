"""Column functions: text, fiscal calendar, rounding and formulas."""
