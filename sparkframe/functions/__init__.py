"""Column expressions and their typing rules."""
