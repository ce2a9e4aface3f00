"""Column expressions that clean raw text fields.

Coercing forms give null for what can't be read; with ``strict`` it is an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def two_digit_date(c: Column, strict: bool = False) -> Column:
    """Month/day/year with two digits: 69-99 are 19xx, 00-68 are 20xx."""
    parsed = F.to_date(c, "M/d/yy") if strict else F.try_to_date(c, "M/d/yy")
    return F.when(F.year(parsed) >= 2069, F.add_months(parsed, -1200)).otherwise(parsed)


def year_date(c: Column, strict: bool = False) -> Column:
    """January 1 of a year written with four digits."""
    text = c.cast("string")
    return F.to_date(text, "yyyy") if strict else F.try_to_date(text, "yyyy")


def default(c: Column, value: str) -> Column:
    return F.coalesce(c, F.lit(value))


def _number(c: Column, strict: bool) -> Column:
    return c.cast("double") if strict else c.try_cast("double")


def second_part(c: Column, separator: str = " / ", drop: str = "", strict: bool = False) -> Column:
    """The number in the second part of a text, null where there is none."""
    part = F.get(F.split(c.cast("string"), separator), F.lit(1))
    return _number(F.replace(part, F.lit(drop), F.lit("")) if drop else part, strict)


def height_m(c: Column, strict: bool = False) -> Column:
    return second_part(c, strict=strict)


def weight_kg(c: Column, strict: bool = False) -> Column:
    return second_part(c, drop=" kg.", strict=strict)


def money(c: Column, strict: bool = False) -> Column:
    """A number after literal dollar signs are taken out; numbers pass."""
    return _number(F.replace(c.cast("string"), F.lit("$"), F.lit("")), strict)


def binary(c: Column, value: str = "USA", other: str = "Not-USA") -> Column:
    return F.when(c.eqNullSafe(F.lit(value)), value).otherwise(other)


def remap(c: Column, old: str = "Undrafted", new: str = "0") -> Column:
    return F.when(c == old, F.lit(new)).otherwise(c)
