"""Column functions and small pure helpers."""
