"""Column expressions over elements and lists of elements."""
