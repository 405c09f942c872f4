"""Column builders shared by the operators (no actions, no Python per row)."""
