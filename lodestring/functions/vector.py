"""Euclidean distances between array columns, summed from left to right in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_squared(a: Column, b: Column) -> Column:
    terms = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))
