"""Column expressions and distributed building blocks shared by operators."""
