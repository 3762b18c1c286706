"""Column expressions and their SQL forms."""
