"""Column expressions and the few scalar functions that plans take as literals."""
