"""Column functions with the string semantics of the rules."""
