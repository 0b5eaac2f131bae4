"""Small column helpers used everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEADING_NUMBER = r"^\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))"
LEADING_INTEGER = r"^\s*([-+]?[0-9]+)"


def leading_number(text: Column) -> Column:
    """The number a text begins with, 0 if it begins with none, null for null: "12.5 m" is 12.5."""
    return F.when(text.isNotNull(), F.coalesce(F.regexp_extract(text, LEADING_NUMBER, 1).try_cast("double"), F.lit(0.0)))


def leading_integer(text: Column) -> Column:
    return F.when(text.isNotNull(), F.coalesce(F.regexp_extract(text, LEADING_INTEGER, 1).try_cast("int"), F.lit(0)))


def scaled(value: Column, by: int = 1000) -> Column:
    """value * by, rounded half up to a long: for results that are compared exactly."""
    return F.floor(value * by + 0.5).cast("long")


def nearest(value: Column) -> Column:
    """Nearest integer, ties up."""
    return F.floor(value + 0.5)


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.least(F.greatest(value, as_column(low)), as_column(high))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def case_of(value: Column, table: dict, default=None) -> Column:
    """table[value] as one CASE; keys may be tuples of values."""
    out = None
    for keys, result in table.items():
        keys = keys if isinstance(keys, tuple) else (keys,)
        out = (F.when if out is None else out.when)(value.isin(*keys), F.lit(result))
    return out.otherwise(F.lit(default)) if default is not None else out
