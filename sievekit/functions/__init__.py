"""Column functions: hashing, text, ranks and scores."""
