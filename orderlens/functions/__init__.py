"""Column expressions and checks shared by the operators."""
