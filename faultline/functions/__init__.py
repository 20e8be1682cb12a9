"""Column expressions: no DataFrame, no Python per row."""
