"""Appending rows from a stream."""
