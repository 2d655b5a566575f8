"""Column expressions: text normalisation, substrings, distances."""

from .text import all_grams, all_substrings, clean_email_body, escape_like, escape_wildcard, grams, keep_letters, sanitize_name
from .vector import l2, l2_squared

__all__ = ["all_grams", "all_substrings", "clean_email_body", "escape_like", "escape_wildcard", "grams", "keep_letters", "l2", "l2_squared", "sanitize_name"]
