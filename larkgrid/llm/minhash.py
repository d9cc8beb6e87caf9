"""Near-duplicate documents by one-permutation MinHash with optimal densification.

A text's set is its distinct word shingles, as 64-bit hashes. One hash of each shingle both picks a
bin (its leading bits) and ranks it there, so one sort of the set gives a signature: the least hash
of each bin. An empty bin takes the value of the first filled bin in an order of its own, which keeps
the chance that two sets agree in a bin equal to their similarity. Bands of bins are bucket keys.

Texts with equal sets are one class from the start, so copies, however many, are one row of all that
follows. In each bucket every class makes one candidate edge, to the bucket's least class (a star), so
edges are bounded by bucket entries. Candidates are confirmed on the full sets. A bucket of different
classes whose members aren't all in one component after that could still hide a link between two of
the others; for these buckets alone, pairs across components are compared too: members whose shingles
occur nowhere else too often drop out, small buckets are joined, and in large ones the members outside
the most common component are compared with all, in blocks, without making pairs. So every pair that
shares a bucket is either confirmed, refused, or in one component.

Full sets are made again from the texts of the classes that are asked for, found by id and text digest.

With 40 bands of 5 bins a pair of similarity 0.8 shares no bucket with a chance of 1e-7.

Defined results: a null or empty text, or one without words, has an empty set and is linked with
nothing; fewer words than a shingle are one shingle. Repeated rows and ids are rows of their own; a
null id is never the smallest unless its component has no other. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkgrid.llm.common import cut, discard, lean, light, remembered, table, text_chunks

BANDS, ROWS = 40, 5
BINS = BANDS * ROWS
#: Members of a bucket whose pairs across components are joined; larger ones are compared in blocks of BLOCK.
FEW, BLOCK, BLOCK_TOKENS = 48, 512, 1 << 19
#: Shingles that a task counts at once, and those of a part.
COUNT_TOKENS, PART_TOKENS = 1 << 20, 1 << 20
#: Words that a task remembers the hash of.
KEEP_WORDS = 150_000
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F)]
EDGES = np.array([(i << 64) // BINS for i in range(BINS)], dtype=np.uint64)
#: For each bin, the order in which it looks for a filled one.
PROBES = np.stack([np.random.default_rng(7919 + i).permutation(BINS) for i in range(BINS)])
BAND_MIX = np.random.default_rng(104729).integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KEEP_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()
remembered["minhash"] = _hashes.clear


def scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * MIX[4]
    h = (h ^ h >> np.uint64(29)) * MIX[5]
    return h ^ h >> np.uint64(32)


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text. A-Z lower-cased, words split at ASCII white space."""
    words = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]
    n = [len(w) for w in words]
    h = np.fromiter((x for w in words for x in map(_hashes.__getitem__, w)), dtype=np.uint64, count=sum(n))
    mixed = np.zeros(max(0, len(h) - k + 1), dtype=np.uint64)
    for i in range(k if len(mixed) else 0):
        mixed = (mixed ^ mixed >> np.uint64(31)) * MIX[6] + h[i : len(h) - k + 1 + i]
    mixed = scramble(mixed)
    at = 0
    for c in n:
        if c == 0:
            yield mixed[:0]
        elif c < k:
            yield np.array([xxhash.xxh3_64_intdigest(h[at : at + c].tobytes(), seed=c)], dtype=np.uint64)
        else:
            s = np.sort(mixed[at : at + c - k + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        at += c


def band_keys(s: np.ndarray) -> np.ndarray:
    """The bucket keys of a sorted, non-empty set; a key tells its band too."""
    at = np.searchsorted(s, EDGES)
    filled = np.concatenate([at[1:], [len(s)]]) > at
    source = np.arange(BINS)
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = PROBES[empty]
        source[empty] = order[np.arange(len(empty)), filled[order].argmax(axis=1)]
    signature = s[at[source]].reshape(BANDS, ROWS)
    return scramble((scramble(signature) * BAND_MIX).sum(axis=1, dtype=np.uint64)).view(np.int64)


def features(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, mark (digest of the text), n (size of the set), fp (its digest; null if empty), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, 1):
            texts = b.column(1).to_pylist()
            n, fp, bands = [], [], []
            for s in shingle_sets(texts, k):
                n.append(len(s))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(band_keys(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "mark", "n", "fp", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col, F.xxhash64(text_col)).mapInArrow(lean(run, "minhash"), f"id {kind}, mark bigint, n bigint, fp binary, bands array<bigint>")


def small(rows: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, for a join."""
    return light(rows, 64 * rows.count())


def sets_of(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """The full sets of wanted classes (node, wid, wmark, fp), each from the texts of one id and digest: node, set.

    A task makes a set once. Equal rows in other tasks may make it again; the caller drops those.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    rows = rows.join(small(wanted), F.col("id").eqNullSafe(F.col("wid")) & (F.col("mark") == F.col("wmark")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in text_chunks(batches, 0):
            nodes = b.column(2).to_pylist()
            new = [i for i, x in enumerate(nodes) if x not in done and not done.add(x)]
            b = b.take(pa.array(new, pa.int64()))
            if len(done) > KEEP_WORDS:
                done.clear()
            keep, sets = [], []
            for i, (s, fp) in enumerate(zip(shingle_sets(b.column(0).to_pylist(), k), b.column(1).to_pylist(), strict=True)):
                if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == fp:
                    keep.append(i)
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(2).take(pa.array(keep, pa.int64())), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])

    return rows.select("text", "fp", "node").mapInArrow(lean(run, "minhash"), "node bigint, set array<bigint>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return left.join(small(pairs), "a").join(right, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b").distinct()


def lone_tokens(sets: DataFrame, parts: int) -> DataFrame:
    """node, single: how many shingles of each set no other set has, at most (40 bits of each are compared).

    Tasks send the shingles that occur once in a chunk with their node, the others once without; a part of
    the shingles is counted by one task. So a shingle that all sets have is sent once for each chunk.
    """
    block = "part bigint, nodes binary, once binary, often binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            node, token = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            token = token.view(np.uint64) >> np.uint64(24)
            order = np.argsort(token, kind="stable")
            node, token = node[order], token[order]
            new = np.concatenate([[True], token[1:] != token[:-1]])
            lone = new & np.append(new[1:], True)
            part = token % np.uint64(parts)
            rows = []
            for some in (lone, new & ~lone):
                at = np.flatnonzero(some)
                at = at[np.argsort(part[at], kind="stable")]
                rows.append((at, np.searchsorted(part[at], np.arange(parts + 1, dtype=np.uint64))))
            (a, i), (b, j) = rows
            cols = [[x[c[p] : c[p + 1]].tobytes() for p in range(parts)] for x, c in ((node[a], i), (token[a], i), (token[b], j))]
            some = [p for p in range(parts) if cols[1][p] or cols[2][p]]
            for s in range(0, len(some), 256):
                yield pa.RecordBatch.from_arrays([pa.array(some[s : s + 256], pa.int64()), *(pa.array([c[p] for p in some[s : s + 256]], pa.binary()) for c in cols)], ["part", "nodes", "once", "often"])

        size = 0
        for b in batches:
            for node, values in zip(b.column(0).to_pylist(), (b.column(1)[i].values.to_numpy(zero_copy_only=False) for i in range(len(b))), strict=True):
                held.append((np.full(len(values), node), values.copy()))
                size += len(values)
                if size >= COUNT_TOKENS:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [])

        def done() -> Iterator[pa.RecordBatch]:
            node, once, often = (np.frombuffer(b"".join(x), dtype=t) for x, t in zip(held, (np.int64, np.uint64, np.uint64), strict=True))
            kinds, at, times = np.unique(once, return_index=True, return_counts=True)
            lone = (times == 1) & ~np.isin(kinds, often)
            nodes, n = np.unique(node[at[lone]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(n.astype(np.int64))], ["node", "single"])

        for b in batches:
            for part, *cols in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != now:
                    if now is not None:
                        yield from done()
                    now, held = part, ([], [], [])
                for x, c in zip(held, cols, strict=True):
                    x.append(c)
        if now is not None:
            yield from done()

    sent = sets.select("node", "set").mapInArrow(lean(send, "minhash"), block).repartition("part").sortWithinPartitions("part")
    return sent.mapInArrow(lean(count, "minhash"), "node bigint, single bigint").groupBy("node").agg(F.sum("single").alias("single"))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for all nodes of edges (a, b) but the roots themselves.

    Alternates large-star and small-star steps until nothing changes; each is a sum by node and a
    join, so a node may have any number of neighbours. Each round is a written table.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        new = cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        discard(now)
        now = new
        got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if got == mark:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._larkgrid_path = now._larkgrid_path
            return out
        mark = got


def several_roots(rows: DataFrame) -> DataFrame:
    """The rows (key, node, n, root, ...) of buckets with more than one root, with their rows (c) and shingles (tokens).

    Of buckets with the same members one is kept: the others have no other pairs.
    """
    h = F.xxhash64("node")
    keys = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c"), F.sum("n").alias("tokens"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64(h)).alias("y"))
    keys = keys.where("lo <> hi").groupBy("c", "x", "y").agg(F.min("key").alias("key"), F.first("tokens").alias("tokens")).select("key", "c", "tokens")
    return rows.drop("c", "tokens").join(cut(keys, "keys"), "key")


def block_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) across roots within large buckets.

    rows: key, node, root, n, c, tokens. Of two members with different roots one is outside the bucket's
    most common root; those outside are held, in blocks of about BLOCK members and BLOCK_TOKENS shingles,
    and all members pass by, dealt to as many tasks as their number asks for. Sets are compared by products
    of matrices. Of the links that are found, only those that join two roots not joined before are returned.
    """
    kinds = rows.groupBy("key", "root").agg(F.count("*").alias("m"), F.sum("n").alias("t"))
    major = kinds.groupBy("key").agg(F.max_by("root", F.struct("m", -F.col("root"))).alias("major"), (F.sum("m") - F.max("m")).alias("m"), F.sum("t").alias("t"), F.sum("m").alias("c"))
    blocks = lambda m, t: F.greatest(F.ceil(F.col(m) / BLOCK), F.ceil(F.col(t) / BLOCK_TOKENS), F.lit(1)).cast("int")
    major = major.select("key", "major", blocks("m", "t").alias("own"), blocks("c", "t").alias("all"))
    slot = lambda seed, parts: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    rows = rows.drop("c", "tokens").join(major, "key")
    held = rows.where("root <> major").withColumn("i", slot(1, "own")).withColumn("j", each("all")).withColumn("side", F.lit(0))
    passing = rows.withColumn("j", slot(2, "all")).withColumn("i", each("own")).withColumn("side", F.lit(1))
    work = held.unionByName(passing).select(F.xxhash64("key", "i", "j").alias("work"), "side", "node", "root")
    # a set travels once for each piece of work, whatever the number of bands that it is asked for in
    asked = work.groupBy("node", "root").agg(F.collect_set(F.struct("work", "side")).alias("asked"))
    met = asked.join(sets, "node").select(F.explode("asked").alias("w"), "node", "root", "set").select("w.work", "w.side", "node", "root", "set")
    met = met.repartition("work").sortWithinPartitions("work", "side", "node")

    def links(own: list, other: list, parent: dict) -> Iterator[tuple[int, int]]:
        """own, other: (node, root, set)."""
        vocabulary = np.unique(np.concatenate([x[2] for x in own]))
        marks, sizes = [], []
        for group in (own, other):
            n = np.array([len(x[2]) for x in group])
            tokens = np.concatenate([x[2] for x in group])
            col = np.minimum(np.searchsorted(vocabulary, tokens), len(vocabulary) - 1)
            known = vocabulary[col] == tokens
            at, col = np.repeat(np.arange(len(group)), n)[known], col[known]
            order = np.argsort(col, kind="stable")
            marks.append((at[order], col[order]))
            sizes.append(n)
        met = np.intersect1d(marks[0][1], marks[1][1])  # columns that both have
        both = np.zeros((len(own), len(other)), dtype=np.float32)
        for s in range(0, len(met), 2048):
            cols, m = met[s : s + 2048], []
            for (at, col), group in zip(marks, (own, other), strict=True):
                i, j = np.searchsorted(col, [cols[0], cols[-1] + 1])
                place = np.minimum(np.searchsorted(cols, col[i:j]), len(cols) - 1)
                ok = cols[place] == col[i:j]
                x = np.zeros((len(group), len(cols)), dtype=np.float32)
                x[at[i:j][ok], place[ok]] = 1
                m.append(x)
            both += m[0] @ m[1].T
        roots = [np.array([x[1] for x in g]) for g in (own, other)]
        good = (100 * both >= percent * (sizes[0][:, None] + sizes[1] - both)) & (roots[0][:, None] != roots[1])
        for i in np.flatnonzero(good.any(axis=1)).tolist():
            for j in np.flatnonzero(good[i]).tolist():
                x, y = own[i][1], other[j][1]
                while parent.setdefault(x, x) != x:
                    x = parent[x]
                while parent.setdefault(y, y) != y:
                    y = parent[y]
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    yield own[i][0], other[j][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, other, parent, size = None, [], [], {}, 0

        def done() -> Iterator[pa.RecordBatch]:
            if own and other and (got := list(links(own, other, parent))):
                a, b = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for b in batches:
            sets_at = b.column(4)
            for i, (work, side, node, root) in enumerate(zip(*(b.column(j).to_pylist() for j in range(4)), strict=True)):
                if work != now or len(other) >= BLOCK or size >= BLOCK_TOKENS:
                    yield from done()
                    other, size = [], 0
                    if work != now:
                        now, own, parent = work, [], {}
                row = (node, root, sets_at[i].values.to_numpy(zero_copy_only=False).copy())
                if side:
                    other.append(row)
                    size += len(row[2])
                else:
                    own.append(row)
        yield from done()

    return met.mapInArrow(lean(run, "minhash"), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col, n_shingles, component_id (the least id that links reach)."""
    rows = cut(features(docs, shingle, id_col, text_col), "features")
    classes = rows.where("fp is not null").groupBy("fp").agg(F.min("id").alias("id"), F.min(F.struct("id", "mark")).alias("who"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    entries = classes.select("node", "n", F.explode("bands").alias("key"))
    buckets = cut(entries.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("hub")).where("c > 1"), "buckets")
    members = cut(entries.join(buckets, "key").select("key", "c", "hub", "node", "n"), "members")

    alike = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))  # noqa: E731  sizes that allow the similarity
    size = classes.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"))
    star = members.where("node <> hub").groupBy("node", "hub", "n").agg(F.lit(1).alias("one")).join(size, "hub").where(alike(F.col("n"), F.col("hub_n")))
    star = cut(star.select(F.col("node").alias("a"), F.col("hub").alias("b")), "star")
    # each class that has a bucket with others may be asked for, now or among the pairs across components
    asked = members.select("node").distinct().join(classes, "node").select("node", F.col("who.id").alias("wid"), F.col("who.mark").alias("wmark"), "fp")
    asked = cut(asked, "asked")
    sets = cut(sets_of(docs, asked, shingle, id_col, text_col), "sets")
    if sets.count() > asked.count():  # equal rows that several tasks have seen
        again, sets = sets, cut(sets.dropDuplicates(["node"]), "sets")
        discard(again)
    links = cut(confirm(star, sets, percent), "links")
    roots = components(links)

    labelled = members.where("c > 2").join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    labelled = cut(labelled, "labelled")
    mixed = cut(several_roots(labelled), "mixed")
    # a shingle that no other of these sets has can't be in an intersection: what is left bounds the similarity
    own = cut(mixed.select("node", "n").distinct(), "own")
    parts = 32 + (own.agg(F.sum("n")).first()[0] or 0) // PART_TOKENS
    single = lone_tokens(sets.join(small(own.select("node")), "node"), parts)
    bound = own.join(single, "node", "left").select("node", (F.col("n") - F.coalesce("single", F.lit(0))).alias("shared")).where(100 * F.col("shared") >= percent * F.col("n"))
    bound = cut(bound, "bound")
    mixed_again = cut(several_roots(mixed.join(bound, "node")), "mixed")
    few = mixed_again.where(F.col("c") <= FEW)
    other = few.select("key", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "root", "shared")])
    most = F.least("shared", "shared2")
    across = few.join(other, "key").where((F.col("node") < F.col("node2")) & (F.col("root") != F.col("root2")) & (100 * most >= percent * (F.col("n") + F.col("n2") - most)))
    across = across.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()
    tested = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    across = cut(across.join(tested, ["a", "b"], "left_anti"), "across")
    more = cut(confirm(across, sets, percent).union(block_links(mixed_again.where(F.col("c") > FEW), sets, percent)), "links")
    if not more.isEmpty():
        discard(roots)
        roots = components(links.union(more))

    placed = classes.select("node", "fp", "id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    placed = cut(placed.join(least, "root").select("fp", "component_id"), "placed")
    discard(classes, buckets, members, star, asked, sets, labelled, mixed, mixed_again, own, bound, across, links, more, roots)
    out = rows.select("id", "n", "fp").join(placed, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set of 4-word shingles, its component and whether it stays."""
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
