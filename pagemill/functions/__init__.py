"""Column functions: text metrics, keys and arrays."""
