"""The engine's queries over the driver's tables, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkgrid.functions import scalars as S
from larkgrid.functions.params import params_columns, spec_of, towns_column
from larkgrid.operators import diagnostics, dictionary, evaluation, parity
from larkgrid.operators.filters import cheap_enough
from larkgrid.plans import grids
from larkgrid.plans.grids import Strategy
from larkgrid.schema import REQUIRED, TOWNS, YEARS, QuerySpec
from larkgrid.sources import reports, transactions
from larkgrid.sources.transactions import LINEITEM_TIES, from_lineitem

FULL, PARTIAL, OTHER, EMPTY = "A5656567B", "A6626226B", "A0123405B", "A0001B"
IDS = [FULL, PARTIAL, OTHER, "A1230B", EMPTY, "ABCDE1F", "ABCDEF"]


def spec_for(identifier: str) -> QuerySpec:
    return spec_of(identifier, ties=LINEITEM_TIES)


def rows_for(spark: SparkSession, sf_dir: str, spec: QuerySpec) -> DataFrame:
    return from_lineitem(spark, sf_dir, spec.year, (spec.month, min(spec.month + spec.x_max - 1, 12)))


def texts(values: list[str]) -> str:
    """A SQL list of text rows."""
    return ", ".join("(" + str(i) + ", '" + v.replace("'", "''").replace("\t", "'||chr(9)||'").replace("\r", "'||chr(13)||'") + "')" for i, v in enumerate(values))


TX = f"""tx AS (SELECT CAST(year(l_shipdate) + 20 AS INTEGER) AS month_year, CAST(month(l_shipdate) AS INTEGER) AS month_month,
  ({TOWNS})[CAST(l_partkey % 10 AS INTEGER) + 1] AS town, CAST(l_suppkey AS VARCHAR) AS block, CAST(60 + 2 * l_quantity AS INTEGER) AS floor_area,
  CAST(floor((60 + 2 * l_quantity) * (4650 + l_extendedprice / 26)) AS BIGINT) AS resale_price, CAST(1966 + l_linenumber AS INTEGER) AS lease_commence_date,
  l_returnflag || l_linestatus AS flat_model, l_orderkey, l_linenumber FROM lineitem)"""
TIES = "l_orderkey, l_linenumber, block"
FIELDS = "month_year, month_month, town, block, floor_area, flat_model, lease_commence_date"


def pool_sql(spec: QuerySpec) -> str:
    towns = ", ".join(f"'{t}'" for t in spec.towns)
    last = min(spec.month + spec.x_max - 1, 12)
    return f"pool AS (SELECT *, CAST(resale_price AS DOUBLE) / floor_area AS ppsm, month_month - {spec.month} + 1 AS off FROM tx WHERE month_year = {spec.year} AND town IN ({towns}) AND month_month BETWEEN {spec.month} AND {last} AND floor_area >= {spec.y_min})"


GRID = "grid AS (SELECT CAST(a.x AS INTEGER) AS x, CAST(b.y AS INTEGER) AS y FROM range(1, 9) a(x), range(80, 151) b(y))"


def best_sql(spec: QuerySpec, name: str = "best", extra: str = "") -> str:
    """The best record of each pair."""
    return f"""{name} AS (SELECT * FROM (SELECT x, y, p.*, row_number() OVER (PARTITION BY x, y ORDER BY ppsm, {TIES}) AS rn
  FROM grid JOIN pool p ON p.off <= x AND p.floor_area >= y) WHERE rn = 1 AND ppsm <= {spec.threshold})"""


def grid_sql(identifier: str) -> str:
    spec = spec_for(identifier)
    return f"WITH {TX}, {pool_sql(spec)}, {GRID}, {best_sql(spec)} SELECT x, y, {FIELDS}, ppsm, CAST(floor(ppsm + 0.5) AS BIGINT) AS ppsm_rounded FROM best"


def grid_with(identifier: str, strategy: Strategy = Strategy()):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        spec = spec_for(identifier)
        return grids.grid_query(rows_for(spark, sf_dir, spec), spec, strategy)

    return query


def single_pair_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = spec_for(FULL)
    return grids.single_pair(rows_for(spark, sf_dir, spec), spec, 1, 80)


def grid_dense_with_no_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = spec_for(PARTIAL)
    return grids.dense_query(rows_for(spark, sf_dir, spec), spec)


def unpacked(frame: DataFrame, *keys: str) -> DataFrame:
    return frame.where("rec is not null").select(*keys, "rec.ppsm", *[f"rec.{c}" for c in LINEITEM_TIES])


def cells_offset_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = spec_for(PARTIAL)
    return unpacked(grids.best_cells(rows_for(spark, sf_dir, spec), spec, Strategy(push_threshold=False)), "off", "bucket")


def prefix_min_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = spec_for(PARTIAL)
    return unpacked(grids.prefix_min(grids.dense(grids.best_cells(rows_for(spark, sf_dir, spec), spec, Strategy(push_threshold=False)), spec)), "x", "y")


def suffix_min_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = spec_for(PARTIAL)
    return unpacked(grids.suffix_min(grids.dense(grids.best_cells(rows_for(spark, sf_dir, spec), spec, Strategy(push_threshold=False)), spec)), "x", "y")


def int_gate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = from_lineitem(spark, sf_dir).where(cheap_enough(spec_for(FULL)))
    return rows.groupBy("month_year").agg(F.count("*").alias("n"), F.sum("resale_price").alias("total_price"))


def threshold_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = S.price_per_area(F.col("resale_price"), F.col("floor_area")) <= 4725
    return from_lineitem(spark, sf_dir).agg(F.count_if(cheap_enough(spec_for(FULL))).alias("by_product"), F.count_if(before).alias("by_division"))


def precomputed_ppsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = from_lineitem(spark, sf_dir).withColumn("price_per_sqm", S.price_per_area(F.col("resale_price"), F.col("floor_area")))
    return rows.groupBy("town").agg(F.min("price_per_sqm").alias("least"), F.max("price_per_sqm").alias("greatest"))


def month_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.date_format(F.add_months("l_shipdate", 240), "MMM-yy").alias("field"))
    year, month = S.month_parts(S.strip(F.col("field")))
    return raw.select(year.alias("year"), month.alias("month")).groupBy("year", "month").agg(F.count("*").alias("n"))


MONTH_FIELDS = ["Jan-15", "dec-25", "JUN-17x", "Jun- 17", "Jan-14", "Jan-26", "2017-06", "Foo-17", "Jun-1", "Jun/17", "Jun-x7", "", "may-+18"]
MONTH_EXPECTED = [(2015, 1), (2025, 12), (2017, 6), (2017, 6), None, None, None, None, None, None, None, None, (2018, 5)]


def frame_of(spark: SparkSession, values: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), "i int, v string")


def month_parse_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    year, month = S.month_parts(S.strip(F.col("v")))
    return frame_of(spark, MONTH_FIELDS).select("i", year.alias("year"), month.alias("month"))


def typed_rows(rows: list[tuple], names: list[str], kinds: list[str]) -> str:
    """A SQL query for literal rows."""
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return "SELECT " + ", ".join(f"CAST({n} AS {k}) AS {n}" for n, k in zip(names, kinds, strict=True)) + f" FROM (VALUES {body}) t({', '.join(names)})"


LINES = ["a,b,c", 'a,"b,c",d', 'say ""x"",1', '"he said ""hi""",2', "a,b,", "single", " a ,\tb\t", "", ",,", 'ab"c,d"e', '"a,b', '  "  p  " ', '"x""', 'a"",b']
LINE_TOKENS = [["a", "b", "c"], ["a", "b,c", "d"], ["say x", "1"], ['he said "hi"', "2"], ["a", "b", ""], ["single"], ["a", "b"], [""], ["", "", ""], ["abc,de"], ["a,b"], ["p"], ['x"'], ["a", "b"]]


def csv_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_of(spark, LINES).select("i", F.posexplode(transactions.tokens(F.col("v"))).alias("pos", "token"))


def lineitem_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as lines of a transaction file, some of them broken, by the order key."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    k = F.col("l_orderkey") % 11
    month = F.when(k == 1, F.date_format("l_shipdate", "yyyy-MM")).otherwise(F.date_format(F.add_months("l_shipdate", 240), "MMM-yy"))
    price = F.when(k == 2, "").when(k == 3, "4294967296").otherwise(F.floor((60 + 2 * F.col("l_quantity")) * (4650 + F.col("l_extendedprice") / 26)).cast("string"))
    area = F.when(k == 4, "65536").otherwise(F.concat((60 + 2 * F.col("l_quantity")).cast("int").cast("string"), F.lit(".75")))
    lease = F.when(k == 5, "1899").otherwise(F.concat((1966 + F.col("l_linenumber")).cast("string"), F.lit("abc")))
    town = F.concat(F.lit(' "TOWN, '), F.col("l_partkey") % 10, F.lit('" '))
    fields = [month, town, F.lit("4 ROOM"), F.col("l_suppkey").cast("string"), F.lit("A ""ST"), F.lit("01 TO 03"), area, F.concat("l_returnflag", "l_linestatus"), lease, price]
    line = F.concat_ws(",", *fields)
    return rows.select(F.monotonically_increasing_id().alias("row_id"), F.when(k == 6, F.concat(line, F.lit(",x"))).when(k == 7, F.lit(" \t")).otherwise(line).alias("value"))


def csv_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = transactions.good_rows(transactions.parse_lines(lineitem_lines(spark, sf_dir), REQUIRED))
    return parsed.groupBy("month_year", "month_month", "town", "flat_model").agg(F.count("*").alias("n"), F.sum("floor_area").cast("bigint").alias("area"), F.sum("resale_price").alias("price"), F.sum("lease_commence_date").cast("bigint").alias("lease"))


CSV_INGEST_SQL = """SELECT CAST(year(l_shipdate) + 20 AS INTEGER) AS month_year, CAST(month(l_shipdate) AS INTEGER) AS month_month, 'TOWN, ' || (l_partkey % 10) AS town, l_returnflag || l_linestatus AS flat_model,
 count(*) AS n, CAST(sum(CAST(60 + 2 * l_quantity AS INTEGER)) AS BIGINT) AS area, CAST(sum(CAST(floor((60 + 2 * l_quantity) * (4650 + l_extendedprice / 26)) AS BIGINT)) AS BIGINT) AS price, CAST(sum(1966 + l_linenumber) AS BIGINT) AS lease
 FROM lineitem WHERE l_orderkey % 11 NOT BETWEEN 1 AND 7 GROUP BY ALL"""


def csv_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as csv_ingest from text files, which are written first."""
    path = transactions.scratch_path(spark, "lines")
    lineitem_lines(spark, sf_dir).select("value").write.option("lineSep", "\n").text(path)
    parsed = transactions.good_rows(transactions.read_csv(spark, path, REQUIRED))
    return parsed.groupBy("month_year", "month_month", "town", "flat_model").agg(F.count("*").alias("n"), F.sum("floor_area").cast("bigint").alias("area"), F.sum("resale_price").alias("price"), F.sum("lease_commence_date").cast("bigint").alias("lease"))


def csv_rejects_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = transactions.parse_lines(lineitem_lines(spark, sf_dir), REQUIRED)
    return transactions.rejected_rows(parsed).groupBy("reject_reason").agg(F.count("*").alias("n"))


def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions.ingest_counts(transactions.parse_lines(lineitem_lines(spark, sf_dir), REQUIRED))


PADDED = ["  a ", "\tb\r", "c", "", " \t\r ", " d e "]
NUMBERS = ["42", "  7x", "-5", "+9.5", "abc", "", "1985abc", "404000.5", "99999999999999999999", "- 3"]
AREAS = ["79.9", "104.99999999", "1e2", ".5", "12abc", "-3.7", "nan", "inf", "0x10", ""]
HALVES = [3413.4, 3413.5, 0.49999999999999994, 0.5, 2.5, 4724.999]


def trim_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_of(spark, PADDED).select("i", S.strip(F.col("v")).alias("v"))


def prefix_int_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_of(spark, NUMBERS).select("i", S.prefix_int(F.col("v")).alias("v"))


def float_trunc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_of(spark, AREAS).select("i", S.truncated(S.prefix_float(F.col("v"))).alias("v"))


def half_up_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = from_lineitem(spark, sf_dir)
    rounded = S.half_up(S.price_per_area(F.col("resale_price"), F.col("floor_area")))
    return rows.select(rounded.alias("ppsm")).groupBy("ppsm").agg(F.count("*").alias("n"))


def town_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_of(spark, IDS).select(F.col("v").alias("id"), F.array_join(towns_column(F.col("v")), "|").alias("towns"))


def query_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    year, month = params_columns(F.col("v"))
    return frame_of(spark, IDS).select(F.col("v").alias("id"), year.alias("year"), month.alias("month"))


def many_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    year, month = params_columns(F.col("v"))
    ids = frame_of(spark, [FULL, PARTIAL, OTHER, EMPTY])
    params = ids.select(F.col("v").alias("id"), year.alias("year"), month.alias("month"), towns_column(F.col("v")).alias("towns"))
    return grids.param_grid(from_lineitem(spark, sf_dir), params, spec_for(FULL))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_lines(grid_with(PARTIAL)(spark, sf_dir))


def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.parse_report(report_lines(spark, sf_dir).select(F.col("line").alias("value")))


def town_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.build(from_lineitem(spark, sf_dir), "town", LINEITEM_TIES)


def dictionary_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = from_lineitem(spark, sf_dir)
    known = dictionary.build(rows, "town", LINEITEM_TIES)
    coded = dictionary.encode(rows.select("town", "resale_price"), known, "town").drop("town")
    back = dictionary.decode(coded, known, "town_id")
    return back.groupBy("town_id", F.col("town_id_value").alias("town")).agg(F.count("*").alias("n"), F.sum("resale_price").alias("price"))


def dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.lookup(dictionary.build(from_lineitem(spark, sf_dir), "flat_model", LINEITEM_TIES), ["NO", "RF", "unknown"])


def dictionary_cardinalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.cardinalities(from_lineitem(spark, sf_dir), ["town", "block", "flat_model", "lease_commence_date"])


def predicate_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.funnel(from_lineitem(spark, sf_dir), spec_for(PARTIAL))


def funnel_sql(spec: QuerySpec) -> str:
    towns = ", ".join(f"'{t}'" for t in spec.towns)
    last = min(spec.month + spec.x_max - 1, 12)
    a, b = f"month_year = {spec.year}", f"town IN ({towns})"
    c, d = f"month_month BETWEEN {spec.month} AND {last}", f"floor_area >= {spec.y_min}"
    p = "CAST(resale_price AS DOUBLE) / floor_area"
    return f"""WITH {TX} SELECT count(*) AS total, count(*) FILTER ({a}) AS after_year, count(*) FILTER ({a} AND {b}) AS after_town, count(*) FILTER ({a} AND {b} AND {c}) AS after_month,
 count(*) FILTER ({a} AND {b} AND {c} AND {d}) AS after_area, min({p}) FILTER ({a} AND {b} AND {c} AND {d}) AS min_ppsm, max({p}) FILTER ({a} AND {b} AND {c} AND {d}) AS max_ppsm,
 count(*) FILTER ({a} AND {b} AND {c} AND {d} AND {p} <= {spec.threshold}) AS within_threshold FROM tx"""


def comparison_counters(town_first: bool):
    return lambda spark, sf_dir: diagnostics.comparison_counts(from_lineitem(spark, sf_dir), spec_for(PARTIAL), town_first)


def counters_sql(spec: QuerySpec, town_first: bool) -> str:
    towns = list(spec.towns)
    tries = f"CASE WHEN list_position({towns}, town) > 0 THEN list_position({towns}, town) ELSE {len(towns)} END"
    window = f"(month_year = {spec.year} AND month_month BETWEEN {spec.month} AND least({spec.month} + x - 1, 12))"
    return f"""WITH {TX}, c AS (SELECT month_year, month_month, floor_area, town, count(*) AS n FROM tx GROUP BY ALL), {GRID}
 SELECT CAST(sum(n) AS BIGINT) AS rows_scanned, CAST(coalesce(sum(CASE WHEN {"true" if town_first else window} THEN n * ({tries}) END), 0) AS BIGINT) AS town_comparisons,
 CAST(coalesce(sum(CASE WHEN {window} AND list_contains({towns}, town) AND floor_area >= y THEN n END), 0) AS BIGINT) AS rows_passed FROM c, grid"""


def two_results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Of two identifiers, by two plans."""
    return grid_with(FULL)(spark, sf_dir), grid_with(PARTIAL, Strategy("cells"))(spark, sf_dir)


def parity_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.missing(*two_results(spark, sf_dir))


def parity_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.extra(*reversed(two_results(spark, sf_dir)))


def parity_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two plans of one identifier agree but for what is planted: one pair gone, one new, two changed."""
    expected, got = grid_with(PARTIAL)(spark, sf_dir), grid_with(PARTIAL, Strategy("cells"))(spark, sf_dir)
    at = lambda x, y: (F.col("x") == x) & (F.col("y") == y)
    new = got.where(at(8, 80)).withColumn("x", F.lit(9))
    got = got.where(~at(8, 81)).withColumn("floor_area", F.when(at(8, 82), F.col("floor_area") + 1).otherwise(F.col("floor_area"))).withColumn("town", F.when(at(8, 83), F.lit("ELSEWHERE")).otherwise(F.col("town"))).union(new)
    mark = lambda df, what: df.select("x", "y", F.lit(what).alias("what"))
    changed = parity.mismatches(expected, got).select("x", "y", F.col("fields").alias("what"))
    return mark(parity.missing(expected, got), "missing").union(mark(parity.extra(expected, got), "extra")).union(changed)


def eval_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every configuration's result: pairs, a checksum, and how many of its pairs the baseline lacks or has otherwise."""
    spec, out, base = spec_for(PARTIAL), None, None
    rows = rows_for(spark, sf_dir, spec)
    for i, (_, strategy) in enumerate(evaluation.CONFIGURATIONS):
        result = grids.grid_query(rows, spec, strategy)
        base = result if base is None else base
        wrong = parity.mismatches(base, result).select("x").union(parity.extra(base, result).select("x")).agg(F.count("*").alias("wrong"))
        one = result.agg(F.count("*").alias("pairs"), F.sum("ppsm_rounded").alias("checksum")).join(F.broadcast(wrong)).select(F.lit(i).alias("config"), "pairs", "checksum", "wrong")
        out = one if out is None else out.union(one)
    return out


def parity_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.mismatches(*two_results(spark, sf_dir))


def parity_sql(what: str) -> str:
    ctes = f"WITH a AS ({grid_sql(FULL)}), b AS ({grid_sql(PARTIAL)})"
    if what in ("missing", "extra"):  # the other way round, what one lacks the other has beyond it
        return f"{ctes} SELECT x, y FROM a ANTI JOIN b USING (x, y)"
    issues = ", ".join(f"CASE WHEN a.{f} IS DISTINCT FROM b.{f} THEN '{f}' END" for f in parity.FIELDS)
    return f"{ctes} SELECT * FROM (SELECT a.x, a.y, concat_ws(',', {issues}) AS fields FROM a JOIN b ON a.x = b.x AND a.y = b.y) WHERE fields <> ''"


def load_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = from_lineitem(spark, sf_dir)
    return transactions.append(rows, rows.where("month_year = 2017")).groupBy("load", "month_year").agg(F.count("*").alias("n"))


def store_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.footprint(from_lineitem(spark, sf_dir), ["town", "block", "flat_model"], 11, ["town", "flat_model"])


def result_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.preview(grid_with(FULL)(spark, sf_dir))


#: Runs of three configurations by metric.
SAMPLES = {"query": [[5.0, 1.0, 2.0, 3.0, 9.0], [4.0, 2.0], [7.0, 7.0, 7.0, 1.0, 8.0, 2.0]], "load": [[8.0], [10.0], [8.0]], "memory": [[4096.0], [1024.0], [4100.0]], "town_comparisons": [[900.0], [0.0], [450.0]]}


def bench_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = [(name, i, diagnostics.trimmed_mean(s)) for name, runs in SAMPLES.items() for i, s in enumerate(runs)]
    return diagnostics.against_baseline(spark.createDataFrame(means, "name string, config int, value double"))


QUERIES = {
    "grid_argmin": grid_with(FULL, Strategy("cells")),
    "grid_cumulative": grid_with(FULL),
    "grid_scan": grid_with(PARTIAL, Strategy("scan", push_threshold=False)),
    "grid_partial": grid_with(PARTIAL),
    "grid_precomputed": grid_with(OTHER, Strategy(precomputed=True)),
    "grid_argmin_empty": grid_with(EMPTY),
    "grid_dense_with_no_result": grid_dense_with_no_result,
    "many_identifiers": many_identifiers,
    "single_pair_argmin": single_pair_argmin,
    "cells_offset_bucket": cells_offset_bucket,
    "prefix_min_by_month": prefix_min_by_month,
    "suffix_min_by_area": suffix_min_by_area,
    "int_gate_filter": int_gate_filter,
    "threshold_equivalence": threshold_equivalence,
    "precomputed_ppsm": precomputed_ppsm,
    "month_parse": month_parse,
    "month_parse_rejects": month_parse_rejects,
    "csv_tokenize": csv_tokenize,
    "csv_ingest": csv_ingest,
    "csv_text_files": csv_text_files,
    "csv_rejects_by_reason": csv_rejects_by_reason,
    "ingest_counters": ingest_counters,
    "trim_ws": trim_ws,
    "prefix_int_parse": prefix_int_parse,
    "float_trunc": float_trunc,
    "half_up_round": half_up_round,
    "town_list": town_list,
    "query_params": query_params,
    "report_lines": report_lines,
    "report_round_trip": report_round_trip,
    "town_dictionary": town_dictionary,
    "dictionary_encode_decode": dictionary_encode_decode,
    "dictionary_lookup": dictionary_lookup,
    "dictionary_cardinalities": dictionary_cardinalities,
    "predicate_funnel": predicate_funnel,
    "comparison_counters": comparison_counters(False),
    "comparison_counters_town_first": comparison_counters(True),
    "parity_missing": parity_missing,
    "parity_extra": parity_extra,
    "parity_mismatch": parity_mismatch,
    "parity_planted": parity_planted,
    "eval_configurations": eval_configurations,
    "grid_dictionary_ids": grid_with(PARTIAL, Strategy("cells", dictionary=True)),
    "load_append": load_append,
    "store_footprint": store_footprint,
    "result_preview": result_preview,
    "bench_metrics": bench_metrics,
}


def _digits_sql() -> str:
    return f"ids AS (SELECT v AS id, list_transform(regexp_extract_all(v, '[0-9]'), lambda d: CAST(d AS INTEGER)) AS d FROM (VALUES {texts(IDS)}) t(i, v))"


def _first_seen(column: str) -> str:
    return f"d AS (SELECT {column} AS value, CAST(row_number() OVER (ORDER BY min(ROW({TIES}))) - 1 AS INTEGER) AS id FROM tx GROUP BY {column})"


def oracles() -> dict[str, str]:
    p = spec_for(PARTIAL)
    base = f"WITH {TX}, {pool_sql(p)}, {GRID}"
    one = spec_for(FULL)
    towns = ", ".join(f"'{t}'" for t in one.towns)
    ppsm = "CAST(resale_price AS DOUBLE) / floor_area"
    running = f"SELECT x, y, ppsm, {TIES} FROM (SELECT x, y, p.*, row_number() OVER (PARTITION BY x, y ORDER BY ppsm, {TIES}) AS rn FROM grid JOIN pool p ON %s) WHERE rn = 1"
    result = f"SELECT x, y, {FIELDS}, CAST(floor(ppsm + 0.5) AS BIGINT) AS ppsm_rounded FROM best"
    bad = "l_orderkey % 11"
    runs = ", ".join(f"('{name}', {i}, {s})" for name, each in SAMPLES.items() for i, s in enumerate(each))
    planted = "(x = 8 AND y = 80) OR (x = 8 AND y BETWEEN 81 AND 83)"
    union = " UNION ALL ".join(f"SELECT '{i}' AS id, * FROM ({grid_sql(i)})" for i in (FULL, PARTIAL, OTHER, EMPTY))
    return {
        "grid_argmin": grid_sql(FULL),
        "grid_cumulative": grid_sql(FULL),
        "grid_scan": grid_sql(PARTIAL),
        "grid_partial": grid_sql(PARTIAL),
        "grid_precomputed": grid_sql(OTHER),
        "grid_argmin_empty": grid_sql(EMPTY),
        "grid_dense_with_no_result": f"{base}, {best_sql(p)} SELECT x, y, {FIELDS}, ppsm, CAST(floor(ppsm + 0.5) AS BIGINT) AS ppsm_rounded, ppsm IS NULL AS no_result FROM grid LEFT JOIN best USING (x, y)",
        "many_identifiers": union,
        "single_pair_argmin": f"WITH {TX} SELECT CAST(1 AS INTEGER) AS x, CAST(80 AS INTEGER) AS y, {FIELDS}, ppsm, CAST(floor(ppsm + 0.5) AS BIGINT) AS ppsm_rounded FROM (SELECT *, {ppsm} AS ppsm FROM tx WHERE month_year = {one.year} AND month_month = {one.month} AND town IN ({towns}) AND floor_area >= 80 ORDER BY ppsm, {TIES} LIMIT 1) WHERE ppsm <= 4725",
        "cells_offset_bucket": f"{base} SELECT CAST(off AS INTEGER) AS off, bucket, ppsm, {TIES} FROM (SELECT *, least(floor_area, 150) AS bucket, row_number() OVER (PARTITION BY off, least(floor_area, 150) ORDER BY ppsm, {TIES}) AS rn FROM pool) WHERE rn = 1",
        "prefix_min_by_month": f"{base} " + running % "p.off <= x AND least(p.floor_area, 150) = y",
        "suffix_min_by_area": f"{base} " + running % "p.off = x AND p.floor_area >= y",
        "int_gate_filter": f"WITH {TX} SELECT month_year, count(*) AS n, CAST(sum(resale_price) AS BIGINT) AS total_price FROM tx WHERE resale_price <= 4725 * CAST(floor_area AS BIGINT) GROUP BY month_year",
        "threshold_equivalence": f"WITH {TX} SELECT count(*) FILTER (resale_price <= 4725 * CAST(floor_area AS BIGINT)) AS by_product, count(*) FILTER ({ppsm} <= 4725) AS by_division FROM tx",
        "precomputed_ppsm": f"WITH {TX} SELECT town, min({ppsm}) AS least, max({ppsm}) AS greatest FROM tx GROUP BY town",
        "month_parse": "SELECT CAST(year(l_shipdate) + 20 AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, count(*) AS n FROM lineitem GROUP BY ALL",
        "month_parse_rejects": typed_rows([(i, *(e or (None, None))) for i, e in enumerate(MONTH_EXPECTED)], ["i", "year", "month"], ["INTEGER"] * 3),
        "csv_tokenize": typed_rows([(i, k, t) for i, ts in enumerate(LINE_TOKENS) for k, t in enumerate(ts)], ["i", "pos", "token"], ["INTEGER", "INTEGER", "VARCHAR"]),
        "csv_ingest": CSV_INGEST_SQL,
        "csv_text_files": CSV_INGEST_SQL,
        "csv_rejects_by_reason": f"SELECT CASE {bad} WHEN 1 THEN 'month' WHEN 2 THEN 'empty' WHEN 3 THEN 'price' WHEN 4 THEN 'area' WHEN 5 THEN 'lease' ELSE 'arity' END AS reject_reason, count(*) AS n FROM lineitem WHERE {bad} BETWEEN 1 AND 6 GROUP BY ALL",
        "ingest_counters": f"SELECT count(*) FILTER ({bad} <> 7) AS lines_read, count(*) FILTER ({bad} NOT BETWEEN 1 AND 7) AS loaded, count(*) FILTER ({bad} BETWEEN 1 AND 6) AS skipped FROM lineitem",
        "trim_ws": f"SELECT CAST(i AS INTEGER) AS i, trim(v, ' ' || chr(9) || chr(10) || chr(13)) AS v FROM (VALUES {texts(PADDED)}) t(i, v)",
        "prefix_int_parse": f"SELECT CAST(i AS INTEGER) AS i, TRY_CAST(regexp_extract(v, '^\\s*([+-]?[0-9]+)', 1) AS BIGINT) AS v FROM (VALUES {texts(NUMBERS)}) t(i, v)",
        "float_trunc": f"SELECT CAST(i AS INTEGER) AS i, CAST(trunc(TRY_CAST(CASE WHEN NOT regexp_matches(v, '^[+-]?0[xX]') THEN regexp_extract(v, '^\\s*([+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?)', 1) END AS FLOAT)) AS INTEGER) AS v FROM (VALUES {texts(AREAS)}) t(i, v)",
        "half_up_round": f"WITH {TX} SELECT CAST(floor({ppsm} + 0.5) AS BIGINT) AS ppsm, count(*) AS n FROM tx GROUP BY 1",
        "town_list": f"WITH {_digits_sql()} SELECT id, coalesce((SELECT string_agg(list_extract({TOWNS}, k + 1), '|' ORDER BY nth) FROM (SELECT k, min(p) AS nth FROM (SELECT unnest(d) AS k, unnest(range(len(d))) AS p) GROUP BY k)), '') AS towns FROM ids",
        "query_params": f"WITH {_digits_sql()} SELECT id, CASE WHEN len(d) >= 2 THEN CAST(({YEARS})[d[-1] + 1] AS INTEGER) END AS year, CASE WHEN len(d) >= 2 THEN CAST(CASE WHEN d[-2] = 0 THEN 10 ELSE d[-2] END AS INTEGER) END AS month FROM ids",
        "report_lines": f"{base}, {best_sql(p)} SELECT x, y, printf('(%d, %d),%d,%02d,%s,%s,%d,%s,%d,%d', x, y, month_year, month_month, town, block, floor_area, flat_model, lease_commence_date, CAST(floor(ppsm + 0.5) AS BIGINT)) AS line FROM best",
        "report_round_trip": f"{base}, {best_sql(p)} {result}",
        "town_dictionary": f"WITH {TX}, {_first_seen('town')} SELECT value, id FROM d",
        "dictionary_encode_decode": f"WITH {TX}, {_first_seen('town')} SELECT id AS town_id, town, count(*) AS n, CAST(sum(resale_price) AS BIGINT) AS price FROM tx JOIN d ON town = value GROUP BY ALL",
        "dictionary_lookup": f"WITH {TX}, {_first_seen('flat_model')} SELECT value, id FROM d WHERE value IN ('NO', 'RF', 'unknown')",
        "dictionary_cardinalities": f"WITH {TX} SELECT count(DISTINCT town) AS town, count(DISTINCT block) AS block, count(DISTINCT flat_model) AS flat_model, count(DISTINCT lease_commence_date) AS lease_commence_date FROM tx",
        "predicate_funnel": funnel_sql(p),
        "comparison_counters": counters_sql(p, False),
        "comparison_counters_town_first": counters_sql(p, True),
        "parity_missing": parity_sql("missing"),
        "parity_extra": parity_sql("extra"),
        "parity_mismatch": parity_sql("mismatch"),
        "load_append": f"WITH {TX} SELECT CAST(0 AS INTEGER) AS load, month_year, count(*) AS n FROM tx GROUP BY ALL UNION ALL SELECT CAST(1 AS INTEGER), month_year, count(*) FROM tx WHERE month_year = 2017 GROUP BY ALL",
        "store_footprint": f"""WITH {TX}, e AS (SELECT DISTINCT 'town' AS c, town AS value FROM tx UNION ALL SELECT DISTINCT 'flat_model', flat_model FROM tx)
 SELECT count(*) AS n_rows, count(*) * 15 AS fixed_bytes, CAST(sum(strlen(town) + strlen(block) + strlen(flat_model)) AS BIGINT) AS text_bytes,
 (SELECT count(*) FROM e) AS dictionary_entries, (SELECT CAST(sum(strlen(value) + 40) AS BIGINT) FROM e) AS dictionary_bytes FROM tx""",
        "result_preview": f"SELECT * FROM ({grid_sql(FULL)}) ORDER BY x, y LIMIT 5",
        "bench_metrics": f"""WITH m AS (SELECT name, CAST(config AS INTEGER) AS config, CASE WHEN len(v) >= 5 THEN list_avg(list_sort(v)[2:-2]) ELSE list_avg(v) END AS value FROM (VALUES {runs}) t(name, config, v))
 SELECT m.name, m.config, m.value, CASE WHEN m.value <> 0 THEN b.value / m.value END AS speedup, (b.value - m.value) / b.value * 100 AS saved_percent FROM m JOIN m b ON b.name = m.name AND b.config = 0""",
        "parity_planted": f"SELECT CAST(CASE WHEN y = 80 THEN 9 ELSE x END AS INTEGER) AS x, y, CASE y WHEN 80 THEN 'extra' WHEN 81 THEN 'missing' WHEN 82 THEN 'floor_area' ELSE 'town' END AS what FROM ({grid_sql(PARTIAL)}) WHERE {planted}",
        "eval_configurations": f"SELECT CAST(config AS INTEGER) AS config, pairs, checksum, CAST(0 AS BIGINT) AS wrong FROM range({len(evaluation.CONFIGURATIONS)}) c(config), (SELECT count(*) AS pairs, CAST(sum(ppsm_rounded) AS BIGINT) AS checksum FROM ({grid_sql(PARTIAL)}))",
        "grid_dictionary_ids": grid_sql(PARTIAL),
    }
