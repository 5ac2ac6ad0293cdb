"""Readers, writers and the inputs derived from the given tables."""
