"""Column expressions and fixed lookup values."""
