"""Column and table functions on raw activity."""
