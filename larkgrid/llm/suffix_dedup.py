"""Removal of long repeated byte strings by external induced sorting of sampled suffixes.

A string of a given length is repeated if it starts at two places. Sorting every suffix of a corpus
would need several times its size on disk, so suffixes are sampled so that each string of the least
length asked for holds a sample, and the same one wherever it occurs: the suffix whose first k bytes
have the least hash of all that start in the string and fit into it. Several lengths share one pass.

1. Samples are written with a hash of their first k bytes and, for each length, a digest of all the bytes
   that a string held by the sample can have (its context). Only samples whose first bytes occur twice go
   on, and where a whole context occurs twice, all of its strings are repeated.
2. One suffix of each context that is left is sorted, exactly and by its bytes, in a priority queue
   that spills sorted runs to disk, and common prefixes of neighbours are worked out as they leave it.
3. Induction: from the order of the suffixes at i follows that of the suffixes at i - 1, by the byte
   there, and a neighbour's common prefix is one byte longer or the least of those passed over. A
   suffix whose common prefix reaches a length with either neighbour starts a repeated string. Suffixes
   that are alone in their class drop out. The bytes to the left are kept on disk for large classes.

Contexts are held equal if their first bytes' 64-bit hash and their 64-bit digest, by another function, are.

Tasks get the samples by the hash of their first bytes. Two suffixes that hold a repeated string agree in
half of the other bytes to the right or in half of those to the left; so a class of more than CLASS
suffixes is dealt out twice, by the one and by the other half, which spreads common lines. A task's
memory is bounded by its run size and a few numbers for each suffix of a class.

Defined results: a null text counts as empty; texts shorter than a length lose nothing; repeated rows
are copies of each other, so of all of them everything goes. Null and repeated ids are allowed.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import shutil
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from larkgrid.llm.common import cut, discard, lean, light, numbered, spill_dir, table, text_chunks

#: Length of the strings that the query removes; that of repeated passages (some 45 words, so that those of over 50 are caught whole); bytes of a sample's hash.
LENGTH, PASSAGE, SAMPLE = 400, 240, 48
#: Lengths have to be less than this.
WIDE = 4096
#: Suffixes of a class that one task gets.
CLASS = 4096
#: Window starts worked on at once, bytes of a sorted run, and suffixes whose left bytes stay in memory.
CHUNK, RUN_BYTES, BLOCK = 1 << 18, 32 << 20, 20_000
POSITION_BITS = np.uint64(22)

_rng = np.random.default_rng(15485863)
LETTERS = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
MULTIPLY = [np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)]
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2^64, to the powers up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = 1 << (n + 1).bit_length()
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(b))]), dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * MULTIPLY[0]
    h = (h ^ h >> np.uint64(29)) * MULTIPLY[1]
    return h ^ h >> np.uint64(32)


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, from running minima of blocks both ways."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    forth = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], forth[w - 1 : w - 1 + n])


def samples(data: np.ndarray, ends: np.ndarray, lengths: tuple[int, ...], k: int) -> Iterator[tuple]:
    """Of concatenated texts that end at `ends`: the number of the text, the place in it, the hash of the first bytes and the digests of the contexts of each sample."""
    starts = np.concatenate([[0], ends[:-1]])
    length = min(lengths)
    w = length - k + 1
    known = np.zeros(0, dtype=np.int64)
    whole = memoryview(np.ascontiguousarray(data))
    for lo in range(0, max(0, len(data) - length + 1), CHUNK):
        hi = min(lo + CHUNK, len(data) - length + 1)  # strings that start from lo to hi
        part = data[lo : min(len(data), hi + length)]
        up, down = powers(len(part))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(LETTERS[part] * up[: len(part)], dtype=np.uint64)])
        n = hi - lo + w - 1
        head = scramble((sums[k : n + k] - sums[:n]) * down[:n])
        order = head >> POSITION_BITS << POSITION_BITS | np.arange(n, dtype=np.uint64)
        least = sliding_least(order, w)
        begin = np.arange(lo, hi)
        text = np.searchsorted(ends, begin, side="right")
        least = least[begin + length <= ends[text]]
        if not len(least):
            continue
        at = np.unique((least & ((np.uint64(1) << POSITION_BITS) - np.uint64(1))).astype(np.int64))
        at = at[~np.isin(at + lo, known)]  # strings on both sides of a chunk's end may share a sample
        first, where = head[at], at + lo
        known = np.concatenate([known, where])[-2 * length :]
        text = np.searchsorted(ends, where, side="right")
        digests = []
        for x in lengths:
            left, right = np.minimum(x - k, where - starts[text]), np.minimum(x, ends[text] - where)
            seeds = (left * WIDE + right).tolist()
            i, j = (where - left).tolist(), (where + right).tolist()
            digests.append(np.array([xxhash.xxh3_64_intdigest(whole[p:q], seed) for p, q, seed in zip(i, j, seeds, strict=True)], dtype=np.uint64).view(np.int64))
        yield text, where - starts[text], first.view(np.int64), digests


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each string ends."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[1:] - offsets[0]


class DiskQueue:
    """A priority queue of tuples: pushes fill sorted runs on disk, pops merge them in order."""

    def __init__(self, run_bytes: int = RUN_BYTES):
        self.run_bytes, self.size, self.items, self.dir, self.runs = run_bytes, 0, [], None, 0

    def push(self, item: tuple, size: int) -> None:
        self.items.append(item)
        self.size += size + 200
        if self.size > self.run_bytes:
            self.dir = self.dir or spill_dir()
            self.items.sort()
            with open(os.path.join(self.dir, f"run{self.runs}"), "wb") as f:
                for i in range(0, len(self.items), 256):
                    pickle.dump(self.items[i : i + 256], f, protocol=5)
            self.runs, self.items, self.size = self.runs + 1, [], 0

    def _run(self, i: int) -> Iterator[tuple]:
        with open(os.path.join(self.dir, f"run{i}"), "rb") as f:
            while True:
                try:
                    block = pickle.load(f)
                except EOFError:
                    return
                yield from block

    def pops(self) -> Iterator[tuple]:
        self.items.sort()
        yield from heapq.merge(*(self._run(i) for i in range(self.runs)), self.items)

    def close(self) -> None:
        if self.dir:
            shutil.rmtree(self.dir, ignore_errors=True)


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] is common, a[:hi] isn't
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


def induce(prefix: np.ndarray, left: np.ndarray, left_n: np.ndarray, lengths: tuple[int, ...], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """From sorted suffixes to those up to the greatest length - k bytes before them.

    prefix: common prefix with the suffix before, 0 at the start of a class; left: the bytes before
    each suffix, nearest first. Yields (number of the length, suffix, least, greatest number of bytes
    before it) of suffixes that start repeated strings.
    """
    n = len(prefix)
    now = np.arange(n)
    shared = np.append(prefix.astype(np.int64), 0)
    group = np.cumsum(prefix < k)
    since = np.full((len(lengths), n), -1)
    most = max(lengths) - k
    for o in range(most + 1):
        longest = np.maximum(shared[:-1], shared[1:])
        for level, length in enumerate(lengths):
            if o > length - k + 1:
                continue
            repeated = np.zeros(n, dtype=bool)
            if o <= length - k:
                repeated[now[longest >= length - o]] = True
            begun = since[level]
            over = np.flatnonzero(~repeated & (begun >= 0))
            if len(over):
                yield level, over, begun[over], np.full(len(over), o - 1)
                begun[over] = -1
            begun[repeated & (begun < 0)] = o
        if o == most or not len(now):
            break
        has = np.flatnonzero(left_n[now] > o)
        key = group[has] * 256 + left[now[has], o]
        order = np.argsort(key, kind="stable")
        key, place = key[order], has[order]  # place: in the order until now
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        new = np.zeros(len(place) + 1, dtype=np.int64)
        i, j = place[same - 1], place[same]
        if len(same):
            new[same] = shared[j]
            far = np.flatnonzero(j - i > 1)
            if len(far):
                bounds = np.empty(2 * len(far), dtype=np.int64)
                bounds[::2], bounds[1::2] = i[far] + 1, j[far] + 1
                new[same[far]] = np.minimum.reduceat(np.append(shared, 0), bounds)[::2]
        linked = np.zeros(len(place) + 1, dtype=bool)
        linked[same] = True
        stay = linked[:-1] | linked[1:]
        start = ~linked[:-1][stay]
        now, group = now[place][stay], np.cumsum(start)
        shared = np.append(new[:-1][stay], 0)
    for level, length in enumerate(lengths):
        over = np.flatnonzero(since[level] >= 0)
        if len(over):
            yield level, over, since[level][over], np.full(len(over), length - k)


def sorted_classes(queue: DiskQueue, k: int, length: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Whole classes of suffixes in order, about BLOCK at a time: their keys, common prefixes, left bytes and how many."""
    keys, prefix, lefts, store = [], [], [], None

    def full() -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        n = np.array([len(x) for x in lefts], dtype=np.int64)
        matrix = np.zeros((len(keys), length - k), dtype=np.uint8)
        for i, x in enumerate(lefts):
            matrix[i, : len(x)] = np.frombuffer(x, dtype=np.uint8)
        if store is not None:
            head_n = np.concatenate(store[1])
            matrix = _Stacked(store[0], len(head_n), matrix, length - k)
            n = np.concatenate([head_n, n])
        return keys, np.array(prefix), matrix, n

    before = None
    try:
        for first, right, left, key in queue.pops():
            c = common(before[1], right) if before and before[0] == first else 0
            if c < k and len(keys) >= BLOCK:
                yield full()
                keys, prefix, lefts = [], [], []
                if store:
                    os.remove(store[0])
                    store = None
            elif len(lefts) >= BLOCK:  # one class: its left bytes go to disk
                store = store or (os.path.join(spill_dir(), "left"), [])
                rows = np.zeros((len(lefts), length - k), dtype=np.uint8)
                for i, x in enumerate(lefts):
                    rows[i, : len(x)] = np.frombuffer(x, dtype=np.uint8)
                with open(store[0], "ab") as f:
                    rows.tofile(f)
                store[1].append(np.array([len(x) for x in lefts], dtype=np.int64))
                lefts = []
            keys.append(key)
            prefix.append(c if c >= k else 0)
            lefts.append(left)
            before = (first, right)
        if keys:
            yield full()
    finally:
        if store:
            shutil.rmtree(os.path.dirname(store[0]), ignore_errors=True)
        queue.close()


class _Stacked:
    """Left bytes on disk, followed by those in memory; read a column of some rows at a time."""

    def __init__(self, path: str, n: int, tail: np.ndarray, width: int):
        self.head, self.n, self.tail = np.memmap(path, dtype=np.uint8, mode="r", shape=(n, width)), n, tail

    def __getitem__(self, at: tuple[np.ndarray, int]) -> np.ndarray:
        rows, column = at
        out = np.empty(len(rows), dtype=np.uint8)
        far = rows < self.n
        out[far] = self.head[rows[far], column]
        out[~far] = self.tail[rows[~far] - self.n, column]
        return out


def repeated_strings(docs: DataFrame, lengths: tuple[int, ...], k: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): the texts as id, mark, text, and by (id, mark) the maximal runs (level, begin, end) that repeated strings cover.

    mark is a digest of the text; it tells rows of one id apart. level: the number of the length.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    key, wholes_of = f"id {kind}, mark bigint", [f"whole{i}" for i in range(len(lengths))]
    short, long = min(lengths), max(lengths)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, 2):
            data, ends = bytes_of(b.column(2))
            for of, at, first, digests in samples(data, ends, lengths, k):
                n = np.diff(np.concatenate([[0], ends]))[of]
                of = pa.array(of)
                yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(at * WIDE + np.minimum(n - at, WIDE - 1)), pa.array(first), *map(pa.array, digests)], ["id", "mark", "place", "first", *wholes_of])

    # place: where a sample is, and how many bytes follow
    sampled = cut(rows.mapInArrow(lean(sample), f"{key}, place bigint, first bigint, " + ", ".join(f"{w} bigint" for w in wholes_of)), "samples")
    at, right = F.shiftright("place", WIDE.bit_length() - 1), F.pmod("place", F.lit(WIDE))
    firsts = cut(sampled.groupBy("first").agg(F.count("*").alias("c")).where("c > 1"), "firsts")  # written, so that hot keys of the join can be split
    twice = cut(sampled.join(firsts, "first"), "twice")
    discard(sampled, firsts)

    # contexts that occur twice: every string in them is repeated. Rows of a hot key are salted by its count
    parts = F.ceil(F.col("c") / CLASS).cast("int")
    sure, widest = None, None
    written = []
    for level, length in enumerate(lengths):
        w = wholes_of[level]
        found = twice.groupBy("first", F.col(w).alias("whole"), "c").agg(F.count("*").alias("times"), F.min(F.struct("mark", "id", "place")).alias("one"))
        found = cut(found, "contexts")
        written.append(found)
        widest = found if length == long else widest
        pairs = cut(found.where("times > 1").select("first", F.col("whole").alias(w), F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt")), "sure")
        written.append(pairs)
        salted = twice.withColumn("salt", F.pmod(F.xxhash64("mark", "place"), parts).cast("int"))
        begin, end = F.greatest(at - (length - k), F.lit(0)), at + F.least(F.lit(length), right)
        spans = salted.join(pairs, ["first", w, "salt"]).where(end - begin >= length).select("id", "mark", F.lit(level).alias("level"), begin.alias("begin"), end.alias("end"))
        sure = spans if sure is None else sure.union(spans)

    # one suffix of each other context, with its bytes
    classes = cut(widest.groupBy("first").agg(F.count("*").alias("m")).where("m > 1"), "classes")
    wanted = widest.join(light(classes, 64 * classes.count()), "first").withColumn("place", F.col("one.place"))
    wanted = cut(wanted.select("one.id", "one.mark", (at * 2 + (F.col("m") > CLASS).cast("int")).alias("at")), "wanted")
    lists = cut(wanted.groupBy(F.col("id").alias("wid"), F.col("mark").alias("wmark")).agg(F.collect_list("at").alias("ats")), "wanted")
    written += [classes, wanted, lists]
    size = lists.agg(F.sum(F.size("ats") * 8 + 48)).first()[0] or 0
    chosen = rows.join(light(lists, size), F.col("id").eqNullSafe(F.col("wid")) & (F.col("mark") == F.col("wmark"))).select("id", "mark", "text", "ats")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # equal rows: one is enough. Few numbers for each text that has samples
        for b in text_chunks(batches, 2):
            texts = b.column(2).cast(pa.large_binary())
            for i in range(len(b)):
                own = (str(b.column(0)[i]), b.column(1)[i].as_py())
                if own in seen:
                    continue
                seen.add(own)
                t, ats = texts[i].as_py(), b.column(3)[i].as_py()
                for s in range(0, len(ats), 4096):
                    some = [(x >> 1, bool(x & 1)) for x in ats[s : s + 4096]]
                    of = pa.array([i] * len(some))
                    classes = np.array([xxhash.xxh3_64_intdigest(t[x : x + k]) for x, _ in some], dtype=np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column(0).take(of), b.column(1).take(of), pa.array([x for x, _ in some], pa.int64()), pa.array(classes), pa.array([large for _, large in some], pa.bool_()),
                            pa.array([t[max(0, x - long + k) : x][::-1] for x, _ in some], pa.binary()), pa.array([t[x : x + long] for x, _ in some], pa.binary()),
                        ],
                        ["id", "mark", "at", "class", "large", "before", "after"],
                    )

    half = (short - k + 1) // 2
    ways = F.array(F.xxhash64("class", F.substring("after", k + 1, half)), F.xxhash64("class", F.lit("left"), F.substring("before", 1, half)))
    suffixes = chosen.mapInArrow(lean(contexts), f"{key}, at bigint, class bigint, large boolean, before binary, after binary")
    suffixes = suffixes.select("id", "mark", "at", "before", "after", F.explode(F.when(F.col("large"), ways).otherwise(F.array("class"))).alias("class")).repartition("class")

    def induction(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = DiskQueue()
        try:
            for b in batches:
                cols = [c.to_pylist() for c in b.columns]
                for i, mark, at, before, after, own in zip(*cols, strict=True):
                    queue.push((own, after, before, (mark, at, i)), len(after) + len(before))
            for keys, prefix, left, left_n in sorted_classes(queue, k, long):
                for level, which, least, most in induce(prefix, left, left_n, lengths, k):
                    got = [keys[x] for x in which.tolist()]
                    at = np.array([x[1] for x in got], dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([x[2] for x in got], id_type), pa.array([x[0] for x in got], pa.int64()), pa.array([level] * len(got), pa.int32()), pa.array(at - most), pa.array(at - least + lengths[level])], ["id", "mark", "level", "begin", "end"])
        finally:
            queue.close()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[{"level": level, "begin": x, "end": y} for level in range(len(lengths)) for x, y in merged(s, level)] for s in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.struct([("level", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())])))], ["id", "mark", "spans"])

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    induced = suffixes.mapInArrow(lean(induction), f"{key}, level int, begin bigint, end bigint")
    spans = sure.union(induced).groupBy("id", "mark").agg(F.collect_set(F.struct("level", "begin", "end")).alias("spans"))
    spans = cut(spans.mapInArrow(lean(runs), f"{key}, spans array<struct<level:int,begin:bigint,end:bigint>>"), "spans")
    discard(twice, *written)
    return rows, spans


def merged(spans: list[dict] | None, level: int = 0) -> list[tuple[int, int]]:
    """Maximal runs that spans of a level cover."""
    out: list[list[int]] = []
    for b, e in sorted((s["begin"], s["end"]) for s in spans or () if s["level"] == level):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [(b, e) for b, e in out]


def remaining(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for b, e in runs:
        out.append(text[at:b])
        at = e
    return b"".join([*out, text[at:]]) if runs else text


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """rows with their spans (null if none). Beyond a small table of spans, texts are hashed to their ids, which are as even as rows are."""
    size = spans.agg(F.sum(F.size("spans") * 32 + 64)).first()[0] or 0
    known = light(spans.select(F.col("id").alias("sid"), F.col("mark").alias("smark"), "spans"), size)
    return rows.join(known, F.col("id").eqNullSafe(F.col("sid")) & (F.col("mark") == F.col("smark")), "left").drop("sid", "smark")


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated strings cut out of their texts; letters that a cut splits go as well. n_chars follows, if there is one."""
    _, spans = repeated_strings(docs, (length,), k, id_col, text_col)
    plain = numbered(docs)
    at, names = docs.columns.index(text_col), plain.columns
    rows = plain.select("*", F.col(f"_c{docs.columns.index(id_col)}").alias("id"), F.xxhash64(F.coalesce(F.col(f"_c{at}"), F.lit(""))).alias("mark"))
    joined = with_spans(rows, spans).drop("id", "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, at):
            texts = [t if t is None or not s else remaining(t.encode(), merged(s)).decode("utf-8", "ignore") for t, s in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True)]
            cols = [pa.array(texts, b.column(at).type) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names)

    out = joined.mapInArrow(lean(run), plain.schema)
    if "n_chars" in docs.columns:
        n = docs.columns.index("n_chars")
        out = out.withColumn(f"_c{n}", F.length(f"_c{at}").cast(docs.schema[n].dataType))
    return out.toDF(*docs.columns)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes, removed bytes and runs, and the digest of what is left.

    passage_bytes and n_passages, beyond that: bytes and runs that shorter repeats, of PASSAGE bytes or more, cover.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, spans = repeated_strings(docs, (LENGTH, PASSAGE), SAMPLE, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, 2):
            out = []
            texts = b.column(2).cast(pa.large_binary())
            for i, s in enumerate(b.column(3).to_pylist()):
                t, runs, passages = texts[i].as_py(), merged(s), merged(s, 1)
                out.append((len(t), sum(e - x for x, e in runs), len(runs), sum(e - x for x, e in passages), len(passages), hashlib.sha256(remaining(t, runs)).hexdigest()))
            *counts, digest = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in counts), pa.array(digest, pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "passage_bytes", "n_passages", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_spans(rows, spans).mapInArrow(lean(run), f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, passage_bytes bigint, n_passages bigint, kept_sha256 string").withColumnRenamed("id", "doc_id")
