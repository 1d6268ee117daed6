"""Column functions: names and types, masking, numbers."""
