"""Exact top-k search with vector-approximation files.

An approximation file is written first: of every vector one byte a dimension, the number of a cell whose
width makes all components fit into 256 cells (CELL units at least). Cells bound the inner product with a
query from both sides: the product with the cells' middles, give or take half a cell times the query's
absolute sum.

1. The file is scanned: of each query the k best by lower bound.
2. The exact vectors of these are read. The kth exact score is sure to be reached.
3. The file is scanned again: only vectors whose upper bound reaches that score are left, best first.
   They are read exactly, and nothing that was not read can be among the k best, so the result is certain.

Queries are a stated set. They go out in chunks of QUERY_BYTES, whose approximate scores are products of
matrices; approximations are read where they lie, and exact vectors only join the pairs that are left.

Defined results: vectors that are null, empty, or have null or non-finite components take no part, nor
do rows without an id; a query finds no row of its own id, and a query id in several rows counts with
the least of its vectors; a repeated row of another id is a neighbour of its own. Vectors meet only those
of their own dimension.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkgrid.llm.common import cut, discard, light, table
from larkgrid.llm.vectors import FOUND, by_dimension, matrix, merge_top, usable

K, QUERY_STEP, SCALE = 20, 20, 64
#: Integer units of a cell, at least; vectors of a block of the file; bytes of queries that are sent out at once.
CELL, VECTORS, QUERY_BYTES = 2, 2048, 16 << 20
PAIRS = "query_id bigint, vec_id bigint"


def cell_width(low: float, high: float) -> float:
    return max(float(CELL), float(np.ceil((high - low + 1) / 256)))


def approximation_file(vectors: DataFrame, low: float, width: float) -> DataFrame:
    """Blocks of cells: n, dim, ids, cells (one byte each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, mat in by_dimension(b.column(0), b.column(1)):
                cells = np.floor((mat - low) / width).astype(np.uint8)
                for s in range(0, len(ids), VECTORS):
                    some = ids[s : s + VECTORS]
                    yield pa.RecordBatch.from_arrays([pa.array([len(some)], pa.int32()), pa.array([mat.shape[1]], pa.int32()), pa.array([some.tobytes()], pa.binary()), pa.array([cells[s : s + VECTORS].tobytes()], pa.binary())], ["n", "dim", "ids", "cells"])

    return cut(vectors.select("id", "vec").mapInArrow(run, "n int, dim int, ids binary, cells binary"), "approximations")


def bounds(queries: np.ndarray, cells: np.ndarray, low: float, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores with the cells' middles, and how far an exact score of integral vectors may be from them, by query."""
    sums = np.abs(queries).sum(axis=1)
    high = abs(low) + 256 * width
    exact = float(sums.max(initial=0)) * 2 * high < 1 << 22  # then half units are exact in single precision
    kind = np.float32 if exact else np.float64
    middle = cells.astype(kind) * kind(width) + kind(low + (width - 1) / 2)
    return queries.astype(kind) @ middle.T, (width - 1) / 2 * sums + (0 if exact else 1e-12 * sums * high)


class Best:
    """The k best scores of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.q, self.ids, self.scores = k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        self.kth = np.full(n, -np.inf)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: queries by vectors; minus infinity for pairs that don't count. Of equal scores at the end any may stay."""
        good = scores > self.kth[:, None]
        if good.sum() > 4 * self.k * len(scores):  # more than any query needs
            good &= scores >= np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k :][:, :1]
        q, at = np.nonzero(good)
        q, new, found = np.concatenate([self.q, q]), np.concatenate([self.ids, ids[at]]), np.concatenate([self.scores, scores[q, at]])
        order = np.lexsort((new, -found, q))
        q = q[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        keep = nth < self.k
        self.q, self.ids, self.scores = q[keep], new[order][keep], found[order][keep]
        last = nth[keep] == self.k - 1
        self.kth[self.q[last]] = self.scores[last]

    def rows(self, query_ids: np.ndarray) -> pa.RecordBatch:
        ends = np.searchsorted(self.q, np.arange(len(query_ids) + 1)).astype(np.int32)
        some = np.flatnonzero(np.diff(ends))
        cut_at = pa.array(np.append(ends[some], ends[-1]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cut_at, pa.array(x)) for x in (self.ids, self.scores)]
        return pa.RecordBatch.from_arrays([pa.array(query_ids[some]), *lists], ["query_id", "ids", "scores"])


def scan_best(file: DataFrame, shared, low: float, width: float, k: int) -> DataFrame:
    """Of each query the k vectors of each task with the best lower bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        best = {dim: Best(len(ids), k) for dim, (ids, _) in held.items()}
        for dim, ids, cells in file_blocks(batches):
            if dim in held:
                own, queries = held[dim]
                near, _ = bounds(queries, cells, low, width)
                near[own[:, None] == ids] = -np.inf
                best[dim].add(near, ids)
        for dim, found in best.items():
            yield found.rows(held[dim][0])

    return file.mapInArrow(run, FOUND)


def scan_reaching(file: DataFrame, shared, sure, low: float, width: float) -> DataFrame:
    """All pairs whose upper bound reaches the query's sure score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, least = shared.value, sure.value
        for dim, ids, cells in file_blocks(batches):
            if dim in held:
                own, queries = held[dim]
                near, reach = bounds(queries, cells, low, width)
                q, at = np.nonzero(near >= (least[dim] - reach)[:, None])
                q, at = (x[own[q] != ids[at]] for x in (q, at))
                yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(ids[at])], ["query_id", "vec_id"])

    return file.mapInArrow(run, PAIRS)


def file_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for b in batches:
        for n, dim, ids, cells in zip(*(c.to_pylist() for c in b.columns), strict=True):
            yield dim, np.frombuffer(ids, dtype=np.int64), np.frombuffer(cells, dtype=np.uint8).reshape(n, dim)


def read_exact(pairs: DataFrame, vectors: DataFrame, shared) -> DataFrame:
    """The exact scores of pairs, as lists. A vector is read if it is in a pair, for all of its pairs at once."""
    wanted = cut(pairs.groupBy("vec_id").agg(F.collect_set("query_id").alias("queries")), "pairs")
    size = wanted.agg(F.sum(F.size("queries") * 8 + 48)).first()[0] or 0
    rows = vectors.join(light(wanted, size), F.col("id") == F.col("vec_id")).select("id", "vec", "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {dim: (np.argsort(ids), ids, mat) for dim, (ids, mat) in shared.value.items()}
        for b in batches:
            dims = np.asarray(b.column(1).value_lengths().to_numpy(zero_copy_only=False))
            for dim in np.unique(dims):
                if dim not in held:
                    continue
                some = b.take(pa.array(np.flatnonzero(dims == dim)))
                order, ids, mat = held[dim]
                n = np.asarray(some.column(2).value_lengths().to_numpy(zero_copy_only=False))
                asked = some.column(2).flatten().to_numpy(zero_copy_only=False)
                at = np.repeat(np.arange(len(some)), n)
                place = order[np.minimum(np.searchsorted(ids, asked, sorter=order), len(ids) - 1)]
                right = ids[place] == asked
                asked, at, place = asked[right], at[right], place[right]
                vec, vec_ids = matrix(some.column(1)), some.column(0).to_numpy(zero_copy_only=False)
                scores = np.concatenate([(vec[at[s : s + 8192]] * mat[place[s : s + 8192]]).sum(axis=1) for s in range(0, len(at), 8192)]) if len(at) else np.zeros(0)
                by = np.argsort(asked, kind="stable")
                asked, found, scores = asked[by], vec_ids[at[by]], scores[by]
                keys, starts = np.unique(asked, return_index=True)
                cut_at = pa.array(np.append(starts, len(asked)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.ListArray.from_arrays(cut_at, pa.array(x)) for x in (found, scores))], ["query_id", "ids", "scores"])

    return rows.mapInArrow(run, FOUND)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, score: Column) -> DataFrame:
    """Both: id, vec with integral components. The k highest inner products of each query."""
    spark = vectors.sparkSession
    vectors = cut(vectors, "vectors")
    queries = cut(queries.groupBy("id").agg(F.min("vec").alias("vec")), "queries")
    sizes = vectors.agg(F.min(F.array_min("vec")).alias("low"), F.max(F.array_max("vec")).alias("high")).first()
    low = float(sizes["low"] or 0)
    width = cell_width(low, float(sizes["high"] or 0))
    file = approximation_file(vectors, low, width)
    chunks = max(1, -(-(queries.agg(F.sum(F.size("vec") * 8 + 8)).first()[0] or 0) // QUERY_BYTES))
    out = None
    for chunk in range(chunks):
        some = queries.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == chunk).toArrow().combine_chunks()  # QUERY_BYTES, about
        held = {mat.shape[1]: (ids, mat) for b in some.to_batches() for ids, mat in by_dimension(b.column(0), b.column(1))}
        shared = spark.sparkContext.broadcast(held)
        likely = merge_top(scan_best(file, shared, low, width, k), k, F.col("s")).select("query_id", "vec_id")
        read = merge_top(read_exact(likely, vectors, shared), k, F.col("s"))
        sure = {r["query_id"]: r["s"] for r in read.groupBy("query_id").agg(F.min("score").alias("s"), F.max("rank").alias("n")).where(F.col("n") >= k).collect()}  # one for each query of the chunk
        least = spark.sparkContext.broadcast({dim: np.array([sure.get(i, -np.inf) for i in ids.tolist()]) for dim, (ids, _) in held.items()})
        found = cut(merge_top(read_exact(scan_reaching(file, shared, least, low, width), vectors, shared), k, score), "nearest")
        out = found if out is None else out.union(found)
        shared.unpersist()
        least.unpersist()
    discard(file, vectors, queries)
    return out


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every 20th vector with all others."""
    rows = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    whole = rows.select("id", F.transform("vec", lambda x: F.floor(x * SCALE).cast("double")).alias("vec"))
    return exact_top_k(whole, whole.where(F.col("id") % QUERY_STEP == 0), K, F.col("s").cast("bigint"))


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
