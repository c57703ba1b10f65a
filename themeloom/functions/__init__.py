"""Column expressions: cleaning, tokens, vectors, hashing, names."""
