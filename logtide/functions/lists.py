"""Lists of first element and rest, as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cons(first: Column, rest: Column) -> Column:
    return F.concat(F.array(first), rest)


def car(items: Column) -> Column:
    """The first element; null for an empty list."""
    return F.get(items, F.lit(0))


def cdr(items: Column) -> Column:
    """All but the first element; an empty list stays empty."""
    return F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))


def is_empty(items: Column) -> Column:
    return F.size(items) == 0
