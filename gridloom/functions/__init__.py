"""Column functions and scalar helpers."""
