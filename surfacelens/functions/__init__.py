"""Column functions and rule tables."""
