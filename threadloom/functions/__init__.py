"""Column functions: no shuffles, everything stays inside one row."""
