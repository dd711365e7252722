"""Column expressions (display labels, clean-up helpers)."""
