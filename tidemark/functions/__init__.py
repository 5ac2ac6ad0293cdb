"""Column expressions and small building blocks."""
