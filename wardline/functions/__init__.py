"""Column functions: clinical rules and text."""
