"""Readers, writers and fixed reference relations."""
