"""Column expressions: tokens, row signatures, vectors."""
