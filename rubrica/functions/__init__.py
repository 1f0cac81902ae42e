"""Column functions: text, JSON pointers and variant values."""
