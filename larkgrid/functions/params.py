"""Query parameters from an identifier: ASCII digits decide, all other letters are ignored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkgrid.schema import TOWNS, YEARS, QuerySpec


def digits_of(identifier: str) -> list[int]:
    return [int(c) for c in identifier if c in "0123456789"]


def town_list(identifier: str) -> list[str]:
    """Towns of the identifier's digits, each once, in order of first occurrence."""
    return [TOWNS[d] for d in dict.fromkeys(digits_of(identifier))]


def year_and_month(identifier: str) -> tuple[int, int]:
    """The last digit gives the year, the one before the month, 0 meaning October."""
    digits = digits_of(identifier)
    if len(digits) < 2:
        raise ValueError("an identifier needs two digits at least")
    return YEARS[digits[-1]], digits[-2] or 10


def spec_of(identifier: str, **more) -> QuerySpec:
    year, month = year_and_month(identifier)
    return QuerySpec(year, month, tuple(town_list(identifier)), **more)


def towns_column(identifier: Column) -> Column:
    """town_list for a column."""
    digits = F.array_distinct(F.regexp_extract_all(identifier, F.lit("([0-9])"), F.lit(1)))
    towns = F.array(*[F.lit(t) for t in TOWNS])
    return F.transform(digits, lambda d: F.element_at(towns, d.cast("int") + 1))


def params_columns(identifier: Column) -> tuple[Column, Column]:
    """year_and_month for a column; null where there are fewer than two digits."""
    digits = F.regexp_extract_all(identifier, F.lit("([0-9])"), F.lit(1))
    enough = F.size(digits) >= 2
    years = F.array(*[F.lit(y) for y in YEARS])
    year = F.when(enough, F.element_at(years, F.try_element_at(digits, F.lit(-1)).cast("int") + 1))
    second = F.try_element_at(digits, F.lit(-2)).cast("int")
    return year, F.when(enough, F.when(second == 0, 10).otherwise(second))
