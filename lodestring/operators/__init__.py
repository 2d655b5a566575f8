"""Relational operators of pattern-constrained vector search."""
