"""Column builders: pointers and primitive types."""
