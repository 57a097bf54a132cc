"""Column expressions and small Arrow helpers on texts and vectors."""
