"""Scalar functions as column expressions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkgrid.schema import MONTHS, YEAR_RANGE


def strip(c: Column) -> Column:
    """Without blanks, tabs, carriage returns and line ends at both ends."""
    return F.btrim(c, F.lit(" \t\r\n"))


def prefix_int(c: Column) -> Column:
    """The integer that a text starts with, after white space and a sign; null if none, or if beyond 64 bits."""
    return F.regexp_extract(c, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint")


def prefix_float(c: Column) -> Column:
    """The decimal number that a text starts with, in single precision. Hexadecimal, infinite and nan forms are null."""
    number = r"^\s*([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
    return F.when(c.rlike(r"^\s*[+-]?0[xX]"), F.lit(None)).otherwise(F.regexp_extract(c, number, 1).try_cast("float"))


def truncated(c: Column) -> Column:
    """Single precision towards zero; null beyond what 32 bits hold."""
    return F.when(F.abs(c) < 2147483647.0, c.cast("int"))


def month_number(name: Column) -> Column:
    """1 to 12 for the first three letters of a month in either case, else 0."""
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(name)).cast("int")


def month_parts(c: Column) -> tuple[Column, Column]:
    """(year, month) of a stripped MMM-YY field; both null if it isn't one or the year is out of range."""
    month = month_number(F.substring(c, 1, 3))
    years = prefix_int(F.substr(c, F.lit(5)))
    year = years + 2000
    good = (F.length(c) >= 6) & (F.substring(c, 4, 1) == "-") & (month > 0) & years.between(YEAR_RANGE[0] - 2000, YEAR_RANGE[1] - 2000)
    return F.when(good, year.cast("int")), F.when(good, month)


def price_per_area(price: Column, area: Column) -> Column:
    """Null where the area is 0."""
    return F.try_divide(price.cast("double"), area.cast("double"))


def month_offset(month: Column, start: int) -> Column:
    return month - F.lit(start) + 1


def end_month(start: int, x: Column) -> Column:
    """The last month of a window of x months; a window never leaves its year."""
    return F.least(F.lit(start) + x - 1, F.lit(12))


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("bigint")


def two_digits(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def pair_label(x: Column, y: Column) -> Column:
    return F.format_string("(%d, %d)", x, y)


def byte_text(n: int) -> str:
    """A size for people."""
    return f"{n} B" if n < 1 << 10 else f"{n >> 10} KB" if n < 1 << 20 else f"{n / (1 << 20):.1f} MB"


def count_text(n: int) -> str:
    return str(n) if n < 1000 else f"{n / 1e3:.1f}K" if n < 10**6 else f"{n / 1e6:.2f}M"
