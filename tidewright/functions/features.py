"""Column expressions for calendar and ratio features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trailing_year(c: Column, strict: bool = False) -> Column:
    """The digits that end a text; below 100 they count from 2000."""
    digits = F.nullif(F.regexp_extract(c.cast("string"), r"(\d+)$", 1), F.lit(""))
    if strict:
        digits = F.coalesce(digits, F.raise_error(F.concat(F.lit("no year at the end of "), F.coalesce(c.cast("string"), F.lit("null")))))
    year = digits.cast("int") if strict else digits.try_cast("int")
    return F.when(year < 100, year + 2000).otherwise(year)


def years_since(year: Column, date: Column) -> Column:
    return year - F.year(date)


def body_mass(weight: Column, height: Column) -> Column:
    """weight / height^2, null at height 0."""
    return F.try_divide(weight, height * height)


def decade(date: Column) -> Column:
    return (F.floor(F.year(date) / 10) * 10).cast("int")
