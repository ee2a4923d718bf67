"""Column expressions and driver-side checks."""
