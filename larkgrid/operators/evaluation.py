"""Evaluation of strategies: load and query time, work, memory and parity of each with the baseline."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from larkgrid.operators import diagnostics, parity
from larkgrid.plans.grids import Strategy, grid_query
from larkgrid.schema import QuerySpec

#: The baseline first: a join of the grid with the rows, threshold last.
CONFIGURATIONS: list[tuple[str, Strategy]] = [
    ("baseline", Strategy("scan", push_threshold=False)),
    ("dictionary", Strategy("scan", push_threshold=False, dictionary=True)),
    ("reuse", Strategy("cumulative", push_threshold=False)),
    ("dictionary, reuse", Strategy("cumulative", push_threshold=False, dictionary=True)),
    ("precomputed price", Strategy("scan", push_threshold=False, precomputed=True)),
    ("integer product", Strategy("scan")),
    ("town first", Strategy("scan", push_threshold=False, town_first=True)),
    ("precomputed price, integer product, town first", Strategy("scan", precomputed=True, town_first=True)),
    ("dictionary, precomputed price, integer product, town first", Strategy("scan", precomputed=True, dictionary=True, town_first=True)),
    ("all", Strategy("cumulative", precomputed=True, dictionary=True, town_first=True)),
]
TEXTS, ENCODED, FIXED_BYTES, PRICE_BYTES = ["town", "block", "flat_model"], ["town", "flat_model"], 11, 8


def evaluate(load: Callable[[], DataFrame], spec: QuerySpec, runs: int = 5) -> list[dict]:
    """A dict for each configuration. load reads the transactions; results are compared with the first configuration's."""
    out, baseline = [], None
    for name, strategy in CONFIGURATIONS:
        begun = time.perf_counter()
        rows = load().cache()
        n = rows.count()
        loaded = time.perf_counter() - begun
        times = []
        for _ in range(max(1, runs)):
            begun = time.perf_counter()
            grid_query(rows, spec, strategy).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begun)
        result = grid_query(rows, spec, strategy).cache()
        baseline = result if baseline is None else baseline
        work = diagnostics.comparison_counts(rows, spec, strategy.town_first).first().asDict()
        if strategy.plan == "cumulative":  # one pass, whatever the number of pairs
            work |= {"rows_scanned": n}
        size = diagnostics.footprint(rows, TEXTS, FIXED_BYTES + PRICE_BYTES * strategy.precomputed, ENCODED if strategy.dictionary else ()).first().asDict()
        out.append({
            "configuration": name, "load": loaded, "query": diagnostics.trimmed_mean(times), "memory": size["fixed_bytes"] + size["text_bytes"] + size["dictionary_bytes"],
            **work, "pairs": result.count(), "dictionary_entries": size["dictionary_entries"], "same": parity.same(baseline, result),
        })
        rows.unpersist()
    return out


def deltas(found: list[dict], spark) -> DataFrame:
    """Speedup and percent saved against the baseline: query and load time, memory, town comparisons."""
    metrics = [(name, i, float(x[name])) for i, x in enumerate(found) for name in ("query", "load", "memory", "town_comparisons")]
    return diagnostics.against_baseline(spark.createDataFrame(metrics, "name string, config int, value double"))
