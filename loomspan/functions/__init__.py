"""Column-level functions that stay inside code generation."""
