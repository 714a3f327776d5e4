"""Expressions: numbers, text, vectors, hashes."""
