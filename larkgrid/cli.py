"""Command line.

    python -m larkgrid.cli <identifier> <csv> [flags]           answer a query, write its result file
    python -m larkgrid.cli check <identifier> <csv> [result]    work the answer out again from the file, by another reader and plan, and compare
    python -m larkgrid.cli eval <identifier> <csv> [runs]       time ten configurations and compare their results
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from larkgrid.functions.params import spec_of
from larkgrid.functions.scalars import byte_text, count_text
from larkgrid.operators import diagnostics, dictionary, evaluation, parity
from larkgrid.plans.grids import Strategy, grid_query
from larkgrid.schema import QuerySpec
from larkgrid.sources.reports import preview, read_report, report_name, write_report
from larkgrid.sources.transactions import good_rows, ingest_counts, read_csv, read_csv_lenient

FLAGS = ("dict-encoding", "reuse", "precompute-ppsm", "int-multiply", "predicate-reorder")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="larkgrid", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("identifier")
    p.add_argument("csv")
    p.add_argument("more", nargs="?", help="check: the result file; eval: the number of runs")
    p.add_argument("--folder", default=".", help="where result files are")
    for flag in FLAGS:
        p.add_argument(f"--{flag}", action="store_true", help="a strategy; results are the same")
    return p


def strategy_of(args: argparse.Namespace) -> Strategy:
    """The plan is `cumulative` with --reuse, else `cells`; the other flags change filters and expressions."""
    return Strategy("cumulative" if args.reuse else "cells", args.int_multiply, args.precompute_ppsm, args.dict_encoding, args.predicate_reorder)


def answer(spark: SparkSession, spec: QuerySpec, args: argparse.Namespace) -> int:
    for flag in FLAGS:
        print(f"{flag}: {'on' if getattr(args, flag.replace('-', '_')) else 'off'}")
    parsed = read_csv(spark, args.csv).cache()
    print("year", spec.year, "month", spec.month, "towns", ", ".join(spec.towns))
    print(ingest_counts(parsed).first().asDict())
    rows = good_rows(parsed)
    if args.dict_encoding:
        print("dictionary sizes", dictionary.cardinalities(rows, ["town", "flat_type", "flat_model", "street_name"]).first().asDict())
    print(diagnostics.funnel(rows, spec).first().asDict())
    result = grid_query(rows, spec, strategy_of(args)).cache()
    preview(result).show()
    path, n = write_report(result, args.identifier, args.folder)
    print(f"{n} pairs written to {path}")
    return 0


def check(spark: SparkSession, spec: QuerySpec, args: argparse.Namespace) -> int:
    path = args.more or os.path.join(args.folder, report_name(args.identifier))
    expected = grid_query(read_csv_lenient(spark, args.csv), spec, Strategy("scan", push_threshold=False)).cache()
    other = read_report(spark, path)
    found = {f.__name__: f(expected, other) for f in (parity.missing, parity.extra, parity.mismatches)}
    diffs = {name: rows.count() for name, rows in found.items()}
    print(f"{expected.count()} pairs expected, {other.count()} in {path}: {diffs}")
    for rows in found.values():
        for r in rows.orderBy("x", "y").limit(10).collect():
            print(r.asDict())
    expected.unpersist()
    return int(any(diffs.values()))


def evaluate(spark: SparkSession, spec: QuerySpec, args: argparse.Namespace) -> int:
    found = evaluation.evaluate(lambda: good_rows(read_csv(spark, args.csv)), spec, int(args.more or 5))
    for x in found:
        print(f"{x['configuration']}: load {x['load'] * 1000:.1f} ms, query {x['query'] * 1000:.1f} ms, scanned {count_text(x['rows_scanned'])}, towns compared {count_text(x['town_comparisons'])}, passed {count_text(x['rows_passed'])}, pairs {x['pairs']}, memory {byte_text(x['memory'])}, dictionary entries {x['dictionary_entries']}, {'same' if x['same'] else 'DIFFERENT'}")
    for r in evaluation.deltas(found, spark).where("config > 0").orderBy("config", "name").collect():
        print(f"{found[r['config']]['configuration']}, {r['name']}: {r['saved_percent'] or 0:+.1f} % saved, {r['speedup'] or 0:.2f} x")
    return int(not all(x["same"] for x in found))


COMMANDS = {"check": check, "eval": evaluate}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    command = COMMANDS[argv.pop(0)] if argv and argv[0] in COMMANDS else answer
    args = parser().parse_args(argv)
    try:
        spec = spec_of(args.identifier)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("larkgrid").getOrCreate()
    try:
        return command(spark, spec, args)
    except Exception as e:  # the boundary of the program
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
