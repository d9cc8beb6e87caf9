"""What a query passes over: funnel, comparison counts and size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkgrid.functions.scalars import end_month, price_per_area
from larkgrid.operators.filters import in_months, in_towns, in_year, large_enough
from larkgrid.plans.grids import grid
from larkgrid.schema import QuerySpec


#: Bytes of a dictionary code in a row, and of an entry beside its text: code, hash and two references.
CODE_BYTES, ENTRY_BYTES = 2, 40


def funnel(rows: DataFrame, spec: QuerySpec) -> DataFrame:
    """Rows left after each predicate of the widest window, and prices of the pool, in one pass."""
    steps = [in_year(spec)]
    for p in (in_towns(spec), in_months(spec), large_enough(spec.y_min)):
        steps.append(steps[-1] & p)
    ppsm = price_per_area(F.col("resale_price"), F.col("floor_area"))
    in_pool = F.when(steps[-1], ppsm)
    return rows.agg(
        F.count("*").alias("total"), *[F.count_if(s).alias(n) for s, n in zip(steps, ("after_year", "after_town", "after_month", "after_area"), strict=True)],
        F.min(in_pool).alias("min_ppsm"), F.max(in_pool).alias("max_ppsm"), F.count_if(in_pool <= spec.threshold).alias("within_threshold"),
    )


def comparison_counts(rows: DataFrame, spec: QuerySpec, town_first: bool = False) -> DataFrame:
    """Rows scanned, town comparisons and rows passed over all pairs, as a scan that stops early would count them.

    Rows are summed up by what the predicates see of them, so the grid meets a few cells.
    """
    towns = list(spec.towns)
    place = F.array_position(F.array(*[F.lit(t) for t in towns]), F.col("town")) if towns else F.lit(0)
    tries = F.when(place > 0, place).otherwise(len(towns)).cast("bigint")
    cells = rows.select((F.col("month_year") == spec.year).alias("right_year"), "month_month", F.least(F.greatest("floor_area", F.lit(spec.y_min - 1)), F.lit(spec.y_max)).alias("area"), tries.alias("tries"), (place > 0).alias("town_ok"))
    cells = cells.groupBy("right_year", "month_month", "area", "tries", "town_ok").agg(F.count("*").alias("n"))
    both = cells.join(F.broadcast(grid(rows.sparkSession, spec)))
    in_window = F.col("right_year") & F.col("month_month").between(F.lit(spec.month), end_month(spec.month, F.col("x")))
    compared: Column = F.lit(True) if town_first else in_window
    return both.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_scanned"),
        F.coalesce(F.sum(F.when(compared, F.col("n") * F.col("tries"))), F.lit(0)).alias("town_comparisons"),
        F.coalesce(F.sum(F.when(in_window & F.col("town_ok") & (F.col("area") >= F.col("y")), F.col("n"))), F.lit(0)).alias("rows_passed"),
    )


def footprint(rows: DataFrame, text_columns: list[str], fixed_bytes: int, encoded: Sequence[str] = ()) -> DataFrame:
    """Rows, bytes of fixed-width fields and of texts; for encoded columns the entries and bytes of their dictionaries.

    A dictionary holds every value and an entry of ENTRY_BYTES for it; codes of CODE_BYTES count as fixed width.
    """
    names = ["n_rows", "fixed_bytes", "text_bytes", "dictionary_entries", "dictionary_bytes"]
    zero, total = F.lit(0).cast("bigint"), lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") for c in text_columns), zero)
    out = rows.agg(F.count("*"), F.count("*") * (fixed_bytes + CODE_BYTES * len(encoded)), total(size), zero, zero).toDF(*names)
    for c in encoded:
        values = rows.where(F.col(c).isNotNull()).select(F.col(c).alias("value")).distinct()
        out = out.union(values.agg(zero, zero, zero, F.count("*"), total(F.octet_length("value") + ENTRY_BYTES)).toDF(*names))
    return out.agg(*[F.sum(n).alias(n) for n in names])


def trimmed_mean(times: list[float]) -> float:
    """With five or more runs without the best and the worst."""
    kept = sorted(times)[1:-1] if len(times) >= 5 else times
    return sum(kept) / len(kept)


def against_baseline(metrics: DataFrame) -> DataFrame:
    """metrics: name, config (0 is the baseline), value. Speedup and percent saved of each configuration."""
    base = metrics.where("config = 0").select("name", F.col("value").alias("base"))
    return metrics.join(F.broadcast(base), "name").select("name", "config", "value", F.try_divide("base", "value").alias("speedup"), (F.try_divide(F.col("base") - F.col("value"), F.col("base")) * 100).alias("saved_percent"))
