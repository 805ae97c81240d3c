"""Column functions: text, hashing, markers, vectors."""
