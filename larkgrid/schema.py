"""Columns, fixed values and the query specification."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Towns by digit, years by last digit, months by name.
TOWNS = ["BEDOK", "BUKIT PANJANG", "CLEMENTI", "CHOA CHU KANG", "HOUGANG", "JURONG WEST", "PASIR RIS", "TAMPINES", "WOODLANDS", "YISHUN"]
YEARS = [2020, 2021, 2022, 2023, 2024, 2015, 2016, 2017, 2018, 2019]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

#: Accepted domains of a transaction's fields.
YEAR_RANGE, LEASE_RANGE, AREA_RANGE, PRICE_RANGE = (2015, 2025), (1900, 2100), (0, 65535), (0, 4294967295)

#: Headers of a transaction file; all are required, others are ignored.
REQUIRED = ["month", "town", "flat_type", "block", "street_name", "storey_range", "floor_area_sqm", "flat_model", "lease_commence_date", "resale_price"]
TEXT_FIELDS = ["town", "block", "street_name", "flat_type", "flat_model", "storey_range"]

TRANSACTIONS = T.StructType(
    [T.StructField("row_id", T.LongType()), T.StructField("month_year", T.IntegerType()), T.StructField("month_month", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in TEXT_FIELDS]
    + [T.StructField("floor_area", T.IntegerType()), T.StructField("lease_commence_date", T.IntegerType()), T.StructField("resale_price", T.LongType())]
)

#: Columns of a best record that a result carries.
PAYLOAD = ["month_year", "month_month", "town", "block", "floor_area", "flat_model", "lease_commence_date"]


@dataclass(frozen=True)
class QuerySpec:
    """One parametrised query: best record for each (x, y) of a grid."""

    year: int
    month: int
    towns: tuple[str, ...]
    x_max: int = 8
    y_min: int = 80
    y_max: int = 150
    threshold: int = 4725
    #: What breaks ties of equal price per area, before anything else about a row.
    ties: tuple[str, ...] = ("row_id",)
