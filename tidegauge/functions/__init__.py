"""Column expressions: losses, vectors, text rules."""
