"""Predicates of a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkgrid.functions.scalars import end_month
from larkgrid.operators import dictionary
from larkgrid.schema import QuerySpec


def in_year(spec: QuerySpec) -> Column:
    return F.col("month_year") == spec.year


def in_months(spec: QuerySpec, x: int | None = None) -> Column:
    """Within the window of x months, the widest if not given."""
    return F.col("month_month").between(spec.month, min(spec.month + (x or spec.x_max) - 1, 12))


def in_towns(spec: QuerySpec) -> Column:
    return F.col("town").isin(list(spec.towns)) if spec.towns else F.lit(False)


def large_enough(y: int | Column) -> Column:
    return F.col("floor_area") >= y


def cheap_enough(spec: QuerySpec) -> Column:
    """The threshold without division: in 64-bit integers, before any aggregation."""
    return F.col("resale_price") <= F.lit(spec.threshold).cast("bigint") * F.col("floor_area")


def in_town_ids(rows: DataFrame, spec: QuerySpec) -> DataFrame:
    """Rows in the query's towns, by ids of a dictionary of the column: towns it does not have drop out, and without any there is no row."""
    known = dictionary.build(rows, "town", spec.ties)
    ids = [r["id"] for r in dictionary.lookup(known, spec.towns).collect()]  # as many as the query has towns
    return dictionary.encode(rows, known, "town").where(F.col("town_id").isin(ids) if ids else F.lit(False)).drop("town_id")


def pool(rows: DataFrame, spec: QuerySpec, push_threshold: bool = True, town_first: bool = False, by_ids: bool = False) -> DataFrame:
    """Rows that can be in any answer. The threshold may go first since a best record beyond it is not reported.

    town_first: the towns are the first conjunct; by_ids: they are compared as dictionary ids.
    """
    time = in_year(spec) & in_months(spec)
    if by_ids:
        out = in_town_ids(rows.where(time & large_enough(spec.y_min)), spec)
    else:
        out = rows.where((in_towns(spec) & time if town_first else time & in_towns(spec)) & large_enough(spec.y_min))
    return out.where(cheap_enough(spec)) if push_threshold else out


def window_of(spec: QuerySpec, x: Column) -> Column:
    return F.col("month_month").between(F.lit(spec.month), end_month(spec.month, x))
