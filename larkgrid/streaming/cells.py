"""The cells of a query kept up to date from a stream of transactions.

A cell is a minimum, so late and repeated rows do no harm, and the state is at most as many cells as the
grid has months and areas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from larkgrid.plans.grids import best_cells, dense, prefix_min, result_columns, suffix_min, within
from larkgrid.schema import QuerySpec


def stream_cells(rows: DataFrame, spec: QuerySpec, name: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that keeps the cells in a table in memory; it handles what there is and then ends."""
    writer = best_cells(rows, spec).writeStream.outputMode("complete").format("memory").queryName(name)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answer(cells: DataFrame, spec: QuerySpec) -> DataFrame:
    """The grid's answer from cells."""
    return result_columns(within(suffix_min(prefix_min(dense(cells, spec))), spec), spec)
