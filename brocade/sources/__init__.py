"""Readers, writers and tables derived from the given ones."""
