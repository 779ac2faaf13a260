"""Column functions: text, hashes, numbers, arrays and time."""
