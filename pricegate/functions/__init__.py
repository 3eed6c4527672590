"""Column expressions: calendar positions and fixed-point numbers."""
