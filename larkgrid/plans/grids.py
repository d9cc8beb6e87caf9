"""The grid of best records, as three plans with the same answers.

`cumulative` is the one for large data: one pass sums rows up to at most x_max * areas cells (partial sums on
the map side, so what is shuffled does not grow with the input), and two window sweeps over these cells give
every (x, y). `cells` joins the grid with the cells instead. `scan` joins the grid with the rows themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkgrid.functions.scalars import month_offset, price_per_area
from larkgrid.operators.filters import in_months, in_towns, in_year, large_enough, pool
from larkgrid.schema import PAYLOAD, QuerySpec


@dataclass(frozen=True)
class Strategy:
    """How to run a query; no choice changes a result."""

    plan: str = "cumulative"
    push_threshold: bool = True
    precomputed: bool = False
    #: Towns are compared as ids of a dictionary; or they are the first conjunct of the filter.
    dictionary: bool = False
    town_first: bool = False


def record(spec: QuerySpec, ppsm: Column | None = None) -> Column:
    """What is compared: price per area, then ties; the rest is carried along."""
    ppsm = price_per_area(F.col("resale_price"), F.col("floor_area")) if ppsm is None else ppsm
    rest = [c for c in PAYLOAD if c not in spec.ties]
    return F.struct(ppsm.alias("ppsm"), *[F.col(c) for c in spec.ties], *[F.col(c) for c in rest])


def grid(spark: SparkSession, spec: QuerySpec) -> DataFrame:
    """All (x, y): x_max * (y_max - y_min + 1) rows."""
    ys = spark.range(spec.y_min, spec.y_max + 1).select(F.col("id").cast("int").alias("y"))
    return ys.select(F.explode(F.sequence(F.lit(1), F.lit(spec.x_max))).alias("x"), "y")


def best_cells(rows: DataFrame, spec: QuerySpec, strategy: Strategy = Strategy()) -> DataFrame:
    """The best record (rec) of each month offset and area, areas beyond y_max in the last."""
    rows = pool(rows, spec, strategy.push_threshold, strategy.town_first, strategy.dictionary)
    ppsm = F.col("price_per_sqm") if strategy.precomputed else None
    offset, bucket = month_offset(F.col("month_month"), spec.month), F.least("floor_area", F.lit(spec.y_max))
    return rows.groupBy(offset.cast("int").alias("off"), bucket.alias("bucket")).agg(F.min(record(spec, ppsm)).alias("rec"))


def dense(cells: DataFrame, spec: QuerySpec) -> DataFrame:
    """A row for each (x, y) with the cell's record or null, which the sweeps need."""
    full = grid(cells.sparkSession, spec)
    return full.join(F.broadcast(cells), (F.col("x") == F.col("off")) & (F.col("y") == F.col("bucket")), "left").select("x", "y", "rec")


def prefix_min(frame: DataFrame) -> DataFrame:
    """The best over months up to x, for each area."""
    before = Window.partitionBy("y").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return frame.withColumn("rec", F.min("rec").over(before))


def suffix_min(frame: DataFrame) -> DataFrame:
    """The best over areas from y on, for each window."""
    above = Window.partitionBy("x").orderBy(F.desc("y")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return frame.withColumn("rec", F.min("rec").over(above))


def all_pairs(rows: DataFrame, spec: QuerySpec, strategy: Strategy = Strategy()) -> DataFrame:
    """x, y, rec for every pair; rec is null where there is no record."""
    spark = rows.sparkSession
    if strategy.precomputed and "price_per_sqm" not in rows.columns:
        rows = rows.withColumn("price_per_sqm", price_per_area(F.col("resale_price"), F.col("floor_area")))
    if strategy.plan == "cumulative":
        return suffix_min(prefix_min(dense(best_cells(rows, spec, strategy), spec)))
    full = grid(spark, spec)
    if strategy.plan == "cells":
        held, fits = best_cells(rows, spec, strategy), (F.col("off") <= F.col("x")) & (F.col("bucket") >= F.col("y"))
        found = held.join(F.broadcast(full), fits).groupBy("x", "y").agg(F.min("rec").alias("rec"))
    elif strategy.plan == "scan":
        ppsm = F.col("price_per_sqm") if strategy.precomputed else None
        held = pool(rows, spec, strategy.push_threshold, strategy.town_first, strategy.dictionary).withColumn("off", month_offset(F.col("month_month"), spec.month)).withColumn("rec", record(spec, ppsm))
        found = held.join(F.broadcast(full), (F.col("off") <= F.col("x")) & large_enough(F.col("y"))).groupBy("x", "y").agg(F.min("rec").alias("rec"))
    else:
        raise ValueError(f"no plan named {strategy.plan}")
    return full.join(F.broadcast(found), ["x", "y"], "left")


def within(frame: DataFrame, spec: QuerySpec) -> DataFrame:
    """Pairs whose best record is within the threshold."""
    return frame.where(F.col("rec.ppsm") <= spec.threshold)


def result_columns(frame: DataFrame, spec: QuerySpec) -> DataFrame:
    """The columns of a result; year and month are those of the record."""
    carried = [F.col(f"rec.{c}").alias(c) for c in PAYLOAD]
    return frame.select("x", "y", *carried, F.col("rec.ppsm").alias("ppsm"), F.floor(F.col("rec.ppsm") + 0.5).cast("bigint").alias("ppsm_rounded"))


def grid_query(rows: DataFrame, spec: QuerySpec, strategy: Strategy = Strategy()) -> DataFrame:
    """The answer: one row for each pair that has a record within the threshold."""
    return result_columns(within(all_pairs(rows, spec, strategy), spec), spec)


def dense_query(rows: DataFrame, spec: QuerySpec, strategy: Strategy = Strategy()) -> DataFrame:
    """A row for every pair, with no_result where there is none within the threshold."""
    frame = all_pairs(rows, spec, strategy)
    ok = F.coalesce(F.col("rec.ppsm") <= spec.threshold, F.lit(False))
    return result_columns(frame.withColumn("rec", F.when(ok, F.col("rec"))), spec).withColumn("no_result", F.col("ppsm").isNull())


def single_pair(rows: DataFrame, spec: QuerySpec, x: int, y: int) -> DataFrame:
    """One pair's best record, or no row; x and y may lie outside the grid."""
    fit = rows.where(in_year(spec) & in_months(spec, x) & in_towns(spec) & large_enough(y))
    best = fit.agg(F.min(record(spec)).alias("rec")).select(F.lit(x).alias("x"), F.lit(y).alias("y"), "rec")
    return result_columns(within(best, spec), spec)


def param_grid(rows: DataFrame, params: DataFrame, spec: QuerySpec) -> DataFrame:
    """Many identifiers in one plan. params: id, year, month, towns; one row for each identifier.

    rows are summed up once by year, month, town and area, whatever the identifiers, and those cells meet the params.
    """
    base = rows.where(large_enough(spec.y_min) & (F.col("resale_price") <= F.lit(spec.threshold).cast("bigint") * F.col("floor_area")))
    cells = base.groupBy("month_year", "month_month", "town", F.least("floor_area", F.lit(spec.y_max)).alias("bucket")).agg(F.min(record(spec)).alias("rec"))
    asked = params.select("id", F.col("year").alias("month_year"), "month", F.explode("towns").alias("town"))
    met = cells.join(asked, ["month_year", "town"]).withColumn("off", F.col("month_month") - F.col("month") + 1).where(F.col("off").between(1, spec.x_max))
    # each cell serves all wider windows and smaller areas: sweeps by identifier over dense grids
    per = met.groupBy("id", F.col("off").alias("x"), F.col("bucket").alias("y")).agg(F.min("rec").alias("rec"))
    full = params.select("id").join(F.broadcast(grid(rows.sparkSession, spec)))
    frame = full.join(per, ["id", "x", "y"], "left")
    frame = frame.withColumn("rec", F.min("rec").over(Window.partitionBy("id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    frame = frame.withColumn("rec", F.min("rec").over(Window.partitionBy("id", "x").orderBy(F.desc("y")).rowsBetween(Window.unboundedPreceding, 0)))
    found = within(frame, spec)
    carried = [F.col(f"rec.{c}").alias(c) for c in PAYLOAD]
    return found.select("id", "x", "y", *carried, F.col("rec.ppsm").alias("ppsm"), F.floor(F.col("rec.ppsm") + 0.5).cast("bigint").alias("ppsm_rounded"))
