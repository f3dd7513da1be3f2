"""Column expressions and the fixed vocabularies they use."""
