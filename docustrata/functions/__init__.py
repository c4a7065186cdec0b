"""Column builders: scalar rules."""
