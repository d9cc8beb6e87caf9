"""Packing of tokenised documents into fixed-length sequences by cutting-stock column generation.

A document is cut into full sequences and a rest. How many pieces there are of each length, at most
`CAPACITY` numbers, is all that the driver sees. There a linear program over the histogram of lengths, in
classes of GRAIN tokens, chooses how often to use each pattern (a multiset of classes that fits a sequence): the master problem is solved by the revised
simplex method from patterns of one length each, and its duals price new patterns by an unbounded
knapsack, solved by dynamic programming over the capacity, until the dual bound, or what the
pieces fill in any case, says that no pattern can gain more than GAP. The solution is rounded down and each pattern is made of lengths that are there;
what rounding to classes leaves free, the shortest piece gives way to a longer one for. Lengths that are
left over are put together by a knapsack that is bounded by what is left. Pieces are ranked within their length and a piece's rank gives its sequence and place by
arithmetic, in parallel: ranks are counted per task and length, and offsets of the tasks are summed up.

Padding: a sequence is padded to the capacity unless its length is a power of two.

Defined results: a null text counts as empty, and each document, the empty one too, has at least the
closing id. Repeated rows are documents of their own. Of other columns, none are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from larkgrid.llm.bpe import encoder, read_vocabulary
from larkgrid.llm.common import cut, lean, light, table, text_chunks

CAPACITY, CLOSING_ID = 1024, 0
#: The linear program ends when it is this near to its bound.
GAP = 5e-4
#: Tokens of a class of lengths.
GRAIN = 8
#: Patterns that one pricing may add, and pivots after which the basis is inverted afresh.
POOL, FRESH = 10, 150


def knapsack(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: most value of lengths that sum to c at most; last[c]: a length in it, 0 to leave a unit free.

    values[l]: of length l, from 1; those of 0 or less aren't taken.
    """
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    lengths = np.flatnonzero(values > 1e-12)
    own = values[lengths]
    for c in range(1, capacity + 1):
        k = np.searchsorted(lengths, c, side="right")
        best[c] = best[c - 1]
        if k:
            v = best[c - lengths[:k]] + own[:k]
            i = int(v.argmax())
            if v[i] > best[c]:
                best[c], last[c] = v[i], lengths[i]
    return best, last


def taken(last: np.ndarray, c: int) -> list[int]:
    out = []
    while c > 0:
        if last[c]:
            out.append(int(last[c]))
            c -= int(last[c])
        else:
            c -= 1
    return out


@dataclass
class Solution:
    """Patterns with how often they are used; the dual bound; how far demand is missed, at most; pivots made."""

    uses: list[tuple[tuple[int, ...], float]]
    bound: float
    error: float
    pivots: int


def solve_patterns(demand: dict[int, int], capacity: int) -> Solution:
    """The linear program: as few sequences as possible that hold at least `demand` pieces of each length.

    The basis starts with patterns of one length each. Demands are shifted a little, each by another
    amount, so that no two rows tie and every pivot gains; the shift is taken back at the end.
    """
    lengths = np.array(sorted(demand))
    m = len(lengths)
    if not m:
        return Solution([], 0.0, 0.0, 0)
    row = {int(x): i for i, x in enumerate(lengths)}
    wanted = np.array([demand[int(x)] for x in lengths], dtype=float)
    shifted = wanted * (1 + 1e-5 * np.random.default_rng(11).random(m))

    def column(p: tuple[int, ...]) -> np.ndarray:
        col = np.zeros(m)
        for q in p:
            col[row[q]] += 1
        return col

    patterns: list[tuple[int, ...] | None] = [(int(x),) * (capacity // int(x)) for x in lengths]  # None: a piece more than wanted
    basis = np.diag(capacity // lengths).astype(float)
    cost = np.ones(m)
    inverse = np.diag(1 / (capacity // lengths))
    x = inverse @ shifted
    pivots = 0

    def enter(col: np.ndarray, p: tuple[int, ...] | None) -> None:
        nonlocal inverse, x, pivots
        way = inverse @ col
        ratio = np.full(m, np.inf)
        up = way > 1e-9
        ratio[up] = x[up] / way[up]
        r = int(ratio.argmin())
        x = np.maximum(x - ratio[r] * way, 0)
        x[r] = ratio[r]
        pivot = inverse[r] / way[r]
        inverse -= np.outer(way, pivot)
        inverse[r] = pivot
        basis[:, r], patterns[r], cost[r] = col, p, float(p is not None)
        pivots += 1
        if pivots % FRESH == 0:
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ shifted, 0)

    values, bound = np.zeros(capacity + 1), float(shifted @ lengths) / capacity  # no sequence holds more than the capacity
    while True:
        y = cost @ inverse
        while y.min() < -1e-9:  # a length of which more pieces may be made than are wanted
            col = np.zeros(m)
            col[int(y.argmin())] = -1
            enter(col, None)
            y = cost @ inverse
        values[lengths] = np.maximum(y, 0)
        best, last = knapsack(values, capacity)
        bound = max(bound, float(shifted @ values[lengths]) / max(1.0, best[capacity]))
        if cost @ x - bound <= GAP * bound:
            break
        # the best pattern that holds a length, for the lengths where that gains most
        gain = values[lengths] + best[capacity - lengths]
        pool = {}
        for i in np.argsort(-gain, kind="stable")[: 4 * POOL]:
            if gain[i] <= 1 + 1e-7 or len(pool) == POOL:
                break
            p = tuple(sorted((int(lengths[i]), *taken(last, capacity - int(lengths[i])))))
            pool.setdefault(p, column(p))
        if not pool:
            break
        names, cols = list(pool), np.stack(list(pool.values()))
        while (price := cols @ (cost @ inverse)).max() > 1 + 1e-7:
            k = int(price.argmax())
            enter(cols[k], names[k])
    inverse = np.linalg.inv(basis)
    x = np.maximum(inverse @ wanted, 0)
    error = float(np.abs(basis @ x - wanted).max())
    return Solution([(p, float(v)) for p, v in zip(patterns, x, strict=True) if p and v > 1e-9], bound, error, pivots)


def fullest(rest: dict[int, float], capacity: int) -> tuple[int, ...]:
    """The longest piece there is, with the fullest sum of others beside it, long ones first.

    A knapsack bounded by what there is, over bit sets of the sums that can be reached.
    """
    first = max(rest)
    room = capacity - first
    sums, steps = 1, []
    full = (1 << (room + 1)) - 1
    for x in sorted(rest, reverse=True):
        have = max(1, int(rest[x])) - (x == first)
        for _ in range(min(have, room // x)):
            wider = (sums | sums << x) & full
            if wider == sums:
                break
            steps.append((x, sums))
            sums = wider
        if sums >> room & 1:
            break
    left, pattern = sums.bit_length() - 1, [first]
    for x, before in reversed(steps):
        if not before >> left & 1:
            pattern.append(x)
            left -= x
    return tuple(sorted(pattern))


def fill_rest(rest: dict[int, int], capacity: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Patterns, and how often, that use up what rounding leaves."""
    rest = {k: v for k, v in rest.items() if v}
    while rest:
        p = fullest(rest, capacity)
        times = min(rest[x] // p.count(x) for x in set(p))
        yield p, times
        for x in p:
            rest[x] -= times
            if not rest[x]:
                del rest[x]


def realise(classes: tuple[int, ...], times: int, rest: dict[int, int], capacity: int, grain: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """A pattern of classes as patterns of lengths that are left, up to `times` uses in all; takes them from rest."""
    while times:
        left, p = dict(rest), []
        for c in sorted(classes, reverse=True):
            own = [x for x in range(max(1, (c - 1) * grain + 1), c * grain + 1) if left.get(x)]
            if not own:
                return
            p.append(max(own, key=lambda x: (left[x], x)))
            left[p[-1]] -= 1
        free = capacity - sum(p)
        shortest = min(p)
        for x in range(min(capacity, shortest + free), shortest, -1):
            if left.get(x):
                p[p.index(shortest)] = x
                break
        p.sort()
        now = min(times, *(rest[x] // p.count(x) for x in set(p)))
        if not now:
            return
        for x in p:
            rest[x] -= now
        times -= now
        yield tuple(p), now


@dataclass
class Plan:
    """For each length, which ranks go to which uses of which patterns. At most a few thousand patterns."""

    capacity: int
    times: list[int] = field(default_factory=list)
    #: by length: greatest rank (exclusive) of each slot, its pattern's first sequence, pieces per sequence, place in it
    ends: dict[int, np.ndarray] = field(default_factory=dict)
    slots: dict[int, np.ndarray] = field(default_factory=dict)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces of these lengths and ranks."""
        seq, off = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for idx in np.split(order, cuts) if len(order) else []:
            n = int(length[idx[0]])
            at = np.searchsorted(self.ends[n], rank[idx], side="right")
            begin = np.concatenate([[0], self.ends[n][:-1]])
            base, each, offset = self.slots[n][at].T
            r = rank[idx] - begin[at]
            seq[idx], off[idx] = base + r // each, offset + (r % each) * n
        return seq, off


def make_plan(demand: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Every piece of `demand` gets a place."""
    use: dict[tuple[int, ...], int] = {}
    rest = dict(demand)
    if full := rest.pop(capacity, 0):
        use[(capacity,)] = full
    grain = GRAIN if capacity % GRAIN == 0 else 1
    classes: dict[int, int] = {}
    for x, n in rest.items():
        c = -(-x // grain)
        classes[c] = classes.get(c, 0) + n
    for p, v in sorted(solve_patterns(classes, capacity // grain).uses, key=lambda u: -u[1]):
        for q, k in realise(p, int(v + 1e-6), rest, capacity, grain):
            use[q] = use.get(q, 0) + k
    for q, k in fill_rest(rest, capacity):
        use[q] = use.get(q, 0) + k
    plan, first = Plan(capacity), 0
    ends, slots, count = {}, {}, {}
    for p, k in sorted(use.items(), key=lambda u: (-u[1], u[0])):
        offset = 0
        for x in sorted(set(p)):
            each = p.count(x)
            count[x] = count.get(x, 0) + each * k
            ends.setdefault(x, []).append(count[x])
            slots.setdefault(x, []).append((first, each, offset))
            offset += x * each
        plan.times.append(k)
        first += k
    plan.ends = {x: np.array(v, dtype=np.int64) for x, v in ends.items()}
    plan.slots = {x: np.array(v, dtype=np.int64) for x, v in slots.items()}
    return plan


PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def cut_documents(docs: DataFrame, vocabulary_path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece, with the task that made it and its rank among that task's pieces of its length."""
    spec = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    closing = CLOSING_ID.to_bytes(4, "little")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(spec.value), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for b in text_chunks(batches, 1):
            of, rows = [], []
            for i, (ids, _) in enumerate(enc(x or "" for x in b.column(1).to_pylist())):
                ids += closing
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    of.append(i)
                    rows.append((start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, seen[length]))
                    seen[length] += 1
            cols = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), *cols, pa.array([task] * len(of), pa.int32())], ["id", "start", "length", "ids_crc32", "doc_tokens", "nth", "task"])

    return docs.select(id_col, text_col).mapInArrow(lean(run, "bpe"), f"id {kind}, {PIECE}, nth bigint, task int").withColumnRenamed("id", id_col)


def pack(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = cut(cut_documents(docs, vocabulary_path, capacity, id_col, text_col), "pieces")
    counts = cut(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    demand = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = docs.sparkSession.sparkContext.broadcast(make_plan(demand, capacity))  # a few thousand patterns
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    offsets = cut(offsets, "piece-offsets")
    ranked = pieces.join(light(offsets, 64 * offsets.count()), ["task", "length"]).select(id_col, "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, off = plan.value.place(b.column(2).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], [*b.schema.names[:5], "sequence_id", "offset"])

    schema = T.StructType([*ranked.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(lean(place, "bpe"), schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 1024 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
