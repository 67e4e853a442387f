"""Relational operators, folds and grouped-map kernels."""
