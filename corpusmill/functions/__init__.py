"""Column functions: everything here builds native expressions."""
