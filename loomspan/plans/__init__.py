"""Queries built from the operators, with their SQL counterparts."""
