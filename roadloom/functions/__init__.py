"""Column expressions: geography and map tags."""
