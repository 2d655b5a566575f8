"""Text expressions. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keep_letters(text: Column) -> Column:
    """ASCII letters alone, then lower case; in this order, so no other letter folds into ASCII."""
    return F.lower(F.regexp_replace(text, "[^a-zA-Z]", ""))


def newlines_to_spaces(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def clean_email_body(text: Column) -> Column:
    """Quoted lines go, everything but letters and digits becomes one space, lower case."""
    unquoted = F.regexp_replace(text, r"(?m)^>.*\n?", "")
    return F.trim(F.lower(F.regexp_replace(unquoted, "[^a-zA-Z0-9]+", " ")))


def escape_wildcard(pattern: Column) -> Column:
    r"""\, * and ? with a backslash before them, for engines with wildcard queries."""
    return F.regexp_replace(pattern, r"([\\*?])", r"\\$1")


def escape_like(pattern: Column) -> Column:
    r"""\, % and _ with a backslash before them, for LIKE."""
    return F.regexp_replace(pattern, r"([\\%_])", r"\\$1")


def sanitize_name(name: Column) -> Column:
    """A name of lower-case letters, digits, - and _ for an external index."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9_-]+", "-")


def grams(s: Column, n: int) -> Column:
    """Every substring of n characters, with repeats, by a look-ahead: linear in the text."""
    return F.regexp_extract_all(s, F.lit(f"(?=(.{{{n}}}))"), F.lit(1))


def all_grams(s: Column, n_max: int) -> Column:
    """The distinct substrings of 1 to n_max characters."""
    return F.array_distinct(F.flatten(F.array(*[grams(s, n) for n in range(1, n_max + 1)])))


def all_substrings(s: Column) -> Column:
    """(g, end) of every substring: as many as the square of the length, so for short strings."""
    n = F.length(s)
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(i, n), lambda j: F.struct(F.substring(s, i, j - i + 1).alias("g"), j.alias("end")))))
