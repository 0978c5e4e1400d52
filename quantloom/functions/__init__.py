"""Column functions: numbers, windows, text."""
