"""Dictionaries of a column: dense ids in the order in which values first occur."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values of a dictionary at most.
MOST = 1 << 16


def build(rows: DataFrame, column: str, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """value, id. Values are summed up first, so only distinct ones are ordered, MOST of them at most: ids have 16 bits. More are an error."""
    first = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(F.struct(*order)).alias("first"))
    number = F.row_number().over(Window.orderBy("first"))
    numbered = first.limit(MOST + 1).select("value", number.alias("number"))
    full = F.raise_error(F.lit("too many values for a dictionary")).cast("int")
    return numbered.select("value", F.when(F.col("number") > MOST, full).otherwise((F.col("number") - 1).cast("int")).alias("id"))


def encode(rows: DataFrame, dictionary: DataFrame, column: str) -> DataFrame:
    """rows with the id of a column's value, null for values that aren't known."""
    return rows.join(dictionary.select(F.col("value").alias(column), F.col("id").alias(f"{column}_id")), column, "left")


def decode(rows: DataFrame, dictionary: DataFrame, column: str) -> DataFrame:
    """rows with the value of an id column; ids that aren't known raise when they are read."""
    known = dictionary.select(F.col("id").alias(column), F.col("value").alias("_value"))
    value = F.when(F.col(column).isNotNull() & F.col("_value").isNull(), F.raise_error(F.lit("id out of range")).cast("string")).otherwise(F.col("_value"))
    return rows.join(known, column, "left").withColumn(f"{column}_value", value).drop("_value")


def lookup(dictionary: DataFrame, values: Sequence[str]) -> DataFrame:
    """value, id of the values that are known."""
    return dictionary.where(F.col("value").isin(list(values)))


def cardinalities(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of each column, in one pass."""
    return rows.agg(*[F.countDistinct(c).alias(c) for c in columns])
