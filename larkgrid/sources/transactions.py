"""Transactions from text files and from lineitem.

The exact reader takes lines apart with patterns: a quote anywhere opens or closes a quoted part, two
quotes within one are a quote, an open part lasts to the end of the line, and every field is stripped. A
byte order mark is accepted. Rows that can't be read go to a side frame with the reason.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkgrid.functions.scalars import month_parts, prefix_float, prefix_int, strip, truncated
from larkgrid.schema import AREA_RANGE, LEASE_RANGE, MONTHS, PRICE_RANGE, REQUIRED, TEXT_FIELDS, TOWNS, TRANSACTIONS, YEAR_RANGE


#: A quoted part: up to a single quote or the end of the line. A field: such parts and others. Possessive, so no line is gone over twice.
QUOTED = r'"([^"]*+(?:""[^"]*+)*+)(?:"|\z)'
FIELD = rf",((?:[^\",]++|{QUOTED.replace('(', '(?:', 1)})*+)"
PARTS = rf'([^"]++)|{QUOTED}'


def tokens(line: Column) -> Column:
    """The fields of a line. Only lines with a quote go through the patterns, others are split."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(FIELD), F.lit(1))

    def unquoted(field: Column) -> Column:
        plain, quoted = (F.regexp_extract_all(field, F.lit(PARTS), F.lit(k)) for k in (1, 2))
        joined = F.array_join(F.zip_with(plain, quoted, lambda a, b: F.concat(a, F.replace(b, F.lit('""'), F.lit('"')))), "")
        return F.when(F.contains(field, F.lit('"')), joined).otherwise(field)

    return F.transform(F.when(F.contains(line, F.lit('"')), F.transform(fields, unquoted)).otherwise(F.split(line, ",", -1)), strip)


def bind_header(names: list[str]) -> dict[str, int]:
    """Where each required column is; a name that occurs twice binds to its last place."""
    places = {n: i for i, n in enumerate(names)}
    missing = [n for n in REQUIRED if n not in places]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return places


def parse_lines(lines: DataFrame, header: list[str]) -> DataFrame:
    """lines: row_id, value. All non-blank lines with the typed columns and reject_reason, which is null for good rows."""
    places = bind_header(header)
    # a generator works each line out once; a plain projection would be copied into every use of its columns
    lines = lines.where(strip(F.col("value")) != "").select("row_id", "value", F.explode(F.array(tokens(F.col("value")))).alias("f"))
    field = {n: F.get("f", F.lit(places[n])) for n in REQUIRED}
    cut = lines.select("row_id", "value", (F.size("f") == len(header)).alias("arity"), *[field[n].alias(f"raw_{n}") for n in REQUIRED])
    year, month = month_parts(F.col("raw_month"))
    area = prefix_float(F.col("raw_floor_area_sqm"))
    lease, price = prefix_int(F.col("raw_lease_commence_date")), prefix_int(F.col("raw_resale_price"))
    parts = F.struct(year.alias("month_year"), month.alias("month_month"), area.alias("area"), lease.alias("lease"), price.alias("price"))
    typed = cut.select("row_id", "value", "arity", *[f"raw_{n}" for n in REQUIRED], F.inline(F.array(parts)))
    empty = F.lit(False)
    for n in ("month", "floor_area_sqm", "lease_commence_date", "resale_price"):
        empty = empty | (F.col(f"raw_{n}") == "")
    bad = lambda c, r: F.coalesce(~F.col(c).between(*r), F.lit(True))
    reason = (
        F.when(~F.col("arity"), "arity").when(empty, "empty").when(F.col("month_year").isNull(), "month")
        .when(bad("area", AREA_RANGE), "area").when(bad("lease", LEASE_RANGE), "lease").when(bad("price", PRICE_RANGE), "price")
    )
    texts = [F.col(f"raw_{n}").alias(n) for n in TEXT_FIELDS]
    ok = F.col("reject_reason").isNull()
    out = typed.withColumn("reject_reason", reason)
    return out.select("row_id", "month_year", "month_month", *texts, F.when(ok, truncated(F.col("area"))).alias("floor_area"), F.when(ok, F.col("lease").cast("int")).alias("lease_commence_date"), F.when(ok, F.col("price")).alias("resale_price"), "value", "reject_reason")


def good_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where("reject_reason is null").select(*TRANSACTIONS.names)


def rejected_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where("reject_reason is not null").select("row_id", "value", "reject_reason")


def ingest_counts(parsed: DataFrame) -> DataFrame:
    """Lines read, loaded and skipped."""
    good = F.col("reject_reason").isNull()
    return parsed.agg(F.count("*").alias("lines_read"), F.count_if(good).alias("loaded"), F.count_if(~good).alias("skipped"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """row_id, value: ids rise in file order. Only a line feed ends a line."""
    return spark.read.option("lineSep", "\n").text(path).select(F.monotonically_increasing_id().alias("row_id"), "value")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; in local mode only, one of our own where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{root or f'file://{tempfile.gettempdir()}/larkgrid-shared'}/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, header: list[str] | None = None) -> DataFrame:
    """A transaction file, parsed; the first line is the header. A folder of files without one needs `header`."""
    lines = read_lines(spark, path)
    if header:
        return parse_lines(lines, header)
    first = lines.orderBy("row_id").limit(1).select("row_id", "value", tokens(F.col("value")).alias("f")).first()
    if first is None or not first["value"].strip(" \t\r\n"):
        raise ValueError(f"no header line in {path}")
    names = [n.removeprefix("﻿") for n in first["f"]]
    return parse_lines(lines.where(F.col("row_id") != first["row_id"]), names)


def read_csv_fast(spark: SparkSession, path: str) -> DataFrame:
    """Spark's own reader, for well-formed files: a quote is special at the ends of a field only. Good rows."""
    raw = spark.read.option("header", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    bind_header(raw.columns)
    raw = raw.select(F.monotonically_increasing_id().alias("row_id"), *[strip(F.coalesce(F.col(n), F.lit(""))).alias(f"raw_{n}") for n in REQUIRED])
    year, month = month_parts(F.col("raw_month"))
    typed = raw.select(
        "row_id", year.alias("month_year"), month.alias("month_month"), *[F.col(f"raw_{n}").alias(n) for n in TEXT_FIELDS],
        prefix_float(F.col("raw_floor_area_sqm")).alias("area"), prefix_int(F.col("raw_lease_commence_date")).alias("lease"), prefix_int(F.col("raw_resale_price")).alias("price"),
    )
    typed = typed.where(F.col("month_year").isNotNull() & F.col("area").between(*AREA_RANGE) & F.col("lease").between(*LEASE_RANGE) & F.col("price").between(*PRICE_RANGE))
    return typed.select("row_id", "month_year", "month_month", *TEXT_FIELDS, truncated(F.col("area")).alias("floor_area"), F.col("lease").cast("int").alias("lease_commence_date"), F.col("price").alias("resale_price"))


def read_csv_lenient(spark: SparkSession, path: str) -> DataFrame:
    """A second, independent reading for checks, by the rules of common CSV libraries. Good rows.

    A quote is special at the start of a field only and a quoted field may hold line ends. Numbers must be
    whole texts, areas are cut off in double precision; of the domains only that of the year is asked for.
    """
    header = spark.read.option("multiLine", True).option("escape", '"').csv(path).limit(1).first()
    if header is None:
        raise ValueError(f"no header line in {path}")
    names = [(n or "").removeprefix("﻿").strip() for n in header]
    places = bind_header(names)
    fields = [f"f{i}" for i in range(len(names))]
    schema = ", ".join(f"{f} string" for f in [*fields, "bad"])
    raw = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").csv(path)
    raw = raw.where("bad is null").select(F.monotonically_increasing_id().alias("row_id"), *[strip(F.coalesce(f"f{places[n]}", F.lit(""))).alias(f"raw_{n}") for n in REQUIRED])
    whole = lambda n, kind="bigint": F.when(F.col(f"raw_{n}").rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(F.col(f"raw_{n}"), F.lit("_"), F.lit(""))).try_cast(kind)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring("raw_month", 1, 3))).cast("int")
    year = F.when(F.substring("raw_month", 4, 1) == "-", F.substring("raw_month", 5, 20)).try_cast("int") + 2000
    area = F.when(F.col("raw_floor_area_sqm").rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.col("raw_floor_area_sqm")).try_cast("double")
    typed = raw.select("row_id", year.alias("month_year"), month.alias("month_month"), *[F.col(f"raw_{n}").alias(n) for n in TEXT_FIELDS], F.when(F.abs(area) < 2147483647, area.cast("int")).alias("floor_area"), whole("lease_commence_date", "int").alias("lease_commence_date"), whole("resale_price").alias("resale_price"))
    return typed.where(F.col("month_year").between(*YEAR_RANGE) & (F.col("month_month") > 0) & F.col("floor_area").isNotNull() & F.col("lease_commence_date").isNotNull() & F.col("resale_price").isNotNull())


def append(*frames: DataFrame) -> DataFrame:
    """Loads one after the other: later rows come after earlier ones in ties."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("load", F.lit(i))
        out = f if out is None else out.unionByName(f)
    return out


def from_lineitem(spark: SparkSession, sf_dir: str, year: int | None = None, months: tuple[int, int] | None = None) -> DataFrame:
    """Transactions derived from lineitem. With a year (and months) the scan prunes by ship date too."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if year:
        first, last = months or (1, 12)
        begin = F.make_timestamp(F.lit(year - 20), F.lit(first), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        over = (year - 20, last + 1) if last < 12 else (year - 19, 1)
        end = F.make_timestamp(F.lit(over[0]), F.lit(over[1]), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        kind = rows.schema["l_shipdate"].dataType
        rows = rows.where((F.col("l_shipdate") >= begin.cast(kind)) & (F.col("l_shipdate") < end.cast(kind)))
    area = 60 + 2 * F.col("l_quantity")
    towns = F.array(*[F.lit(t) for t in TOWNS])
    return rows.select(
        (F.year("l_shipdate") + 20).alias("month_year"),
        F.month("l_shipdate").alias("month_month"),
        F.element_at(towns, (F.col("l_partkey") % 10 + 1).cast("int")).alias("town"),
        F.col("l_suppkey").cast("string").alias("block"),
        area.cast("int").alias("floor_area"),
        F.floor(area * (4650 + F.col("l_extendedprice") / 26)).cast("bigint").alias("resale_price"),
        (1966 + F.col("l_linenumber")).cast("int").alias("lease_commence_date"),
        F.concat("l_returnflag", "l_linestatus").alias("flat_model"),
        "l_orderkey",
        "l_linenumber",
    )


#: What breaks ties among derived transactions.
LINEITEM_TIES = ("l_orderkey", "l_linenumber", "block")

