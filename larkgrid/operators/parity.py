"""Comparison of two results by (x, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["x", "y"]
#: Fields that are compared; text of any kind, so results read from files can be compared too.
FIELDS = ["month_year", "month_month", "town", "block", "floor_area", "ppsm_rounded"]


def missing(expected: DataFrame, got: DataFrame) -> DataFrame:
    """Pairs that only the expected result has."""
    return expected.join(got, KEYS, "left_anti").select(*KEYS)


def extra(expected: DataFrame, got: DataFrame) -> DataFrame:
    """Pairs that only the other result has."""
    return got.join(expected, KEYS, "left_anti").select(*KEYS)


def mismatches(expected: DataFrame, got: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """Pairs of both results with the names of fields that differ."""
    other = got.select(*KEYS, *[F.col(f).alias(f"{f}_got") for f in fields])
    issues = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"{f}_got")), F.lit(f)) for f in fields]))
    return expected.join(other, KEYS).select(*KEYS, F.concat_ws(",", issues).alias("fields")).where("fields <> ''")


def same(expected: DataFrame, got: DataFrame) -> bool:
    return all(d.isEmpty() for d in (missing(expected, got), extra(expected, got), mismatches(expected, got)))
