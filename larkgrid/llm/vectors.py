"""Blocks of vectors: how the two searches move vectors about.

A block is one row with ids and a matrix as bytes: its size is bounded and all rows are alike. Blocks
that are to meet have a key in common; of each key, one side is held (it must be bounded) while the
other streams past, so a task needs memory for the held side and one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = "n int, dim int, ids binary, data binary"
#: Entries that a task holds.
KEEP = 2_000_000
FOUND = "query_id bigint, ids array<bigint>, scores array<double>"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vec (doubles) of the vectors that take part: with an id, not empty, and all components finite."""
    vec = F.col(vector_col).cast("array<double>")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec"))
    return rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.coalesce(bad, F.lit(True)))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one dimension as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def by_dimension(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the rows of each dimension; vectors of different dimensions never meet."""
    dims = np.asarray(vectors.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    for d in np.unique(dims):
        at = pa.array(np.flatnonzero(dims == d))
        yield ids.take(at).to_numpy(zero_copy_only=False).astype(np.int64), matrix(vectors.take(at))


def block_rows(parts: list[tuple[list[int], np.ndarray, np.ndarray]], names: list[str]) -> pa.RecordBatch:
    """parts: leading integers, ids and matrix of each block. Data is in single precision where that loses nothing."""
    lead = [pa.array([p[0][i] for p in parts], pa.int64()) for i in range(len(names))]
    data = []
    for *_, mat in parts:
        single = mat.astype(np.float32)
        data.append((single if (single == mat).all() else np.ascontiguousarray(mat, dtype=np.float64)).tobytes())
    cols = [pa.array([len(p[1]) for p in parts], pa.int32()), pa.array([p[2].shape[1] for p in parts], pa.int32()), pa.array([p[1].tobytes() for p in parts], pa.binary()), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays([*lead, *cols], [*names, "n", "dim", "ids", "data"])


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix, in double precision."""
    kind = np.float64 if len(row["data"]) == 8 * row["n"] * row["dim"] else np.float32
    return np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["data"], dtype=kind).astype(np.float64).reshape(row["n"], row["dim"])


def reduced(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, best first, ties to smaller ids; an id counts once, with its greatest score."""
    order = np.lexsort((-scores, ids, q))
    q, ids, scores = q[order], ids[order], scores[order]
    new = np.concatenate([[True], (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])]) if len(q) else np.zeros(0, dtype=bool)
    q, ids, scores = q[new], ids[new], scores[new]
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], ids[keep], scores[keep]


def as_lists(q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    """Entries sorted by query as a row for each query."""
    keys, starts = np.unique(q, return_index=True)
    ends = pa.array(np.append(starts, len(q)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (ids, scores))], ["query_id", "ids", "scores"])


def meet(held: DataFrame, passing: DataFrame, work: Callable, k: int) -> DataFrame:
    """Blocks with a column `key` each. work(list of held blocks, a passing block) gives entries (query, id, score) as arrays.

    A task merges the entries of its keys, KEEP at a time, to the k best of each query.
    """

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for i in range(len(b)):
                yield {name: b.column(j)[i].as_py() for j, name in enumerate(b.schema.names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, prepared, kept, size = None, [], None, [], 0
        for row in groups(batches):
            if row["key"] != key:
                key, own, prepared = row["key"], [], None
            if not row["side"]:
                own.append(unpack(row))
                continue
            if not own:
                continue
            if prepared is None:
                prepared = work(own)
            kept.append(prepared(*unpack(row)))
            size += len(kept[-1][0])
            if size > KEEP:
                kept = [reduced(*(np.concatenate(x) for x in zip(*kept, strict=True)), k)]
                size = len(kept[0][0])
                if size > KEEP // 2:  # many queries: what is known of them goes on
                    yield as_lists(*kept[0])
                    kept, size = [], 0
        if kept:
            yield as_lists(*reduced(*(np.concatenate(x) for x in zip(*kept, strict=True)), k))

    cols = ["key", "side", "n", "dim", "ids", "data"]
    both = held.withColumn("side", F.lit(0)).select(cols).union(passing.withColumn("side", F.lit(1)).select(cols))
    return both.repartition("key").sortWithinPartitions("key", "side").mapInArrow(run, FOUND)


def merge_top(found: DataFrame, k: int, score: Column, once: bool = False) -> DataFrame:
    """The k best of each query over its lists, ranked. score: from the double `s`.

    once: an id that turns up several times for a query counts once, with its greatest score.
    """
    pair = lambda s, v: F.struct(s.alias("s"), v.alias("v"))
    pairs = F.transform(F.arrays_zip("scores", "ids"), lambda x: pair(-x["scores"], x["ids"]))
    if once:  # by id first, so that an id's entries are neighbours, the best in front
        pairs = F.transform(pairs, lambda x: F.struct(x["v"].alias("v"), x["s"].alias("s")))
    best = found.select("query_id", pairs.alias("best")).groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list("best"))).alias("best"))
    if once:
        first = lambda x, i: (i == 0) | (x["v"] != F.get("best", i - 1)["v"])
        best = best.select("query_id", F.array_sort(F.transform(F.filter("best", first), lambda x: pair(x["s"], x["v"]))).alias("best"))
    best = best.select("query_id", F.slice("best", 1, k).alias("best"))
    ranked = best.select("query_id", F.posexplode("best").alias("pos", "b"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.v").alias("vec_id"), (-F.col("b.s")).alias("s")).select("query_id", "rank", "vec_id", score.alias("score"))
