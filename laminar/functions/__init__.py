"""Column idioms used across the operators."""
