"""Column expressions over level texts, tokens and paths."""
