"""Result files: the plain format, in which a pair's label has a bare comma, and a quoted one."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkgrid.functions.scalars import pair_label, two_digits

#: Fixed value: the header of result files.
HEADER = "(x, y),Year,Month,Town,Block,Floor_Area,Flat_Model,Lease_Commence_Date,Price_Per_Square_Meter"


def report_lines(result: DataFrame) -> DataFrame:
    """x, y, line of a result."""
    fields = [pair_label(F.col("x"), F.col("y")), F.col("month_year").cast("string"), two_digits(F.col("month_month")), "town", "block", F.col("floor_area").cast("string"), "flat_model", F.col("lease_commence_date").cast("string"), F.col("ppsm_rounded").cast("string")]
    return result.select("x", "y", F.concat_ws(",", *[F.coalesce(f, F.lit("")) if not isinstance(f, str) else F.coalesce(F.col(f), F.lit("")) for f in fields]).alias("line"))


def report_name(identifier: str) -> str:
    return f"ScanResult_{identifier}.csv"


def write_report(result: DataFrame, identifier: str, folder: str = ".") -> tuple[str, int]:
    """Writes ScanResult_<identifier>.csv, replacing it; a result has a row for each pair at most. Path and rows written."""
    path = os.path.join(folder, report_name(identifier))
    lines = [r["line"] for r in report_lines(result).orderBy("x", "y").collect()]
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write("".join(f"{x}\n" for x in [HEADER, *lines]))
    return path, len(lines)


def write_quoted(result: DataFrame, path: str) -> None:
    """A folder with one well-formed CSV file of the same columns."""
    names = HEADER.removeprefix("(x, y),").split(",")
    out = result.orderBy("x", "y").select(
        pair_label(F.col("x"), F.col("y")).alias("(x, y)"), F.col("month_year").alias(names[0]), two_digits(F.col("month_month")).alias(names[1]), F.col("town").alias(names[2]), F.col("block").alias(names[3]),
        F.col("floor_area").alias(names[4]), F.col("flat_model").alias(names[5]), F.col("lease_commence_date").alias(names[6]), F.col("ppsm_rounded").alias(names[7]),
    )
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def parse_report(lines: DataFrame) -> DataFrame:
    """value: lines of either format, header and blank lines among them. The columns of a result."""
    pattern = r'^﻿?"?\((\d+), (\d+)\)"?,(\d+),(\d+),("(?:[^"]|"")*"|[^,]*),("(?:[^"]|"")*"|[^,]*),(\d+),("(?:[^"]|"")*"|[^,]*),(\d+),(\d+)\s*$'
    part = lambda k: F.regexp_extract("value", pattern, k)
    text = lambda k: F.regexp_replace(F.regexp_replace(part(k), '^"|"$', ""), '""', '"')
    return lines.where(F.col("value").rlike(pattern)).select(
        part(1).cast("int").alias("x"), part(2).cast("int").alias("y"), part(3).cast("int").alias("month_year"), part(4).cast("int").alias("month_month"), text(5).alias("town"), text(6).alias("block"),
        part(7).cast("int").alias("floor_area"), text(8).alias("flat_model"), part(9).cast("int").alias("lease_commence_date"), part(10).cast("bigint").alias("ppsm_rounded"),
    )


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return parse_report(spark.read.option("lineSep", "\n").text(path))


def preview(result: DataFrame, n: int = 5) -> DataFrame:
    """The first rows in order of pairs."""
    return result.orderBy("x", "y").limit(n)
