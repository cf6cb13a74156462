"""Column expressions: complex numbers, array cells, rounding."""
