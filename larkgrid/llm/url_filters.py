"""URL filters by a Bloom filter cascade (native DataFrame expressions only).

A rule is a host with a path prefix and a verdict. The keys that could match a url are its host
suffixes joined to prefixes of its path, but only in the shapes (labels in the host, length of the
path) that some rule has, so every url has a small, bounded number of candidate keys.

The listed keys go into the first Bloom filter. The key universe is known (all candidate keys of
the corpus), so the keys that pass by mistake are found and go into a second filter, the listed
keys that pass that one go into a third, and so on until none is left over. Membership is then
exact for every key in the corpus, and judging a url takes bit tests but no join.

Defined results: a null url, or one without `://`, has an empty host and path and no rule. Where
two fitting rules have the same length, a blocking one goes first. Rules repeated in the list count
once; a key listed as both block and allow is blocked. Columns of the input are kept unless they
have the name of a result column, in which case the result replaces them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkgrid.llm.common import cut, discard, table

#: Bits of a filter for each key in it, and hash functions; about one key in a hundred passes wrongly.
BITS_PER_KEY, HASHES = 10, 7
#: Far more levels than filters that err once in a hundred can need.
MAX_LEVELS = 64

#: The rules of the query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


class Level:
    """One filter: its bits as bytes, the lowest bit of a byte first."""

    def __init__(self, bits: int, data: bytes, seed: int):
        self.bits, self.seed, self.data = bits, seed, F.lit(data)

    def has(self, key: Column) -> Column:
        """Whether all bits of the key are set."""
        found = None
        for pos in positions(key, self.bits, self.seed):
            byte = F.conv(F.hex(F.substr(self.data, (F.shiftright(pos, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            bit = F.getbit(byte, F.pmod(pos, F.lit(8)).cast("int")) == 1
            found = bit if found is None else found & bit
        return found


def positions(key: Column, bits: int, seed: int) -> list[Column]:
    """The key's bits by double hashing."""
    a, b = F.xxhash64(key, F.lit(seed)), F.xxhash64(F.lit(seed), key)
    return [F.pmod(F.pmod(a, F.lit(bits)) + i * (F.pmod(b, F.lit(bits - 1)) + 1), F.lit(bits)) for i in range(HASHES)]


def filter_of(keys: DataFrame, n: int, seed: int) -> Level:
    """The Bloom filter of a column `key`: words are or-ed on the executors, only they come back."""
    bits = max(64, 1 << math.ceil(math.log2(max(1, n) * BITS_PER_KEY)))
    pos = keys.select(F.explode(F.array(*positions(F.col("key"), bits, seed))).alias("pos"))
    rows = pos.groupBy(F.shiftright("pos", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(pos, 64) as int))")).alias("v")).toArrow()  # at most bits / 64 rows
    words = np.zeros(bits // 64, dtype="<i8")
    words[rows.column("w").to_numpy()] = rows.column("v").to_numpy()
    return Level(bits, words.tobytes(), seed)


def build_cascade(listed: DataFrame, universe: DataFrame, seed: int) -> list[Level]:
    """Filters that tell keys of `listed` from all others in `universe`.

    Both have a column `key`. Only keys that pass the first filter are ever gathered, so what is
    written is about the list plus a hundredth of the universe.
    """
    n = listed.count()
    if not n:
        return []
    levels = [filter_of(listed, n, seed)]
    wrong = cut(universe.where(levels[0].has(F.col("key"))).distinct().join(listed, "key", "left_anti"), "cascade")
    inside, outside = listed, wrong  # what the newest filter holds, and what must not pass it
    while True:
        passed = outside.where(levels[-1].has(F.col("key"))) if len(levels) > 1 else outside
        n = passed.count()
        if not n:
            break
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("filters of a cascade do not tell the keys apart")
        level = filter_of(passed, n, seed + len(levels))
        inside, outside = passed, inside
        levels.append(level)
    discard(wrong)
    return levels


def member(key: Column, levels: list[Level]) -> Column:
    """Exact membership of a key of the universe: the first filter that it fails decides."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(levels[i].has(key), out).otherwise(F.lit(i % 2 == 1))
    return out


def url_host(url: Column) -> Column:
    after = F.substr(url, F.instr(url, "://") + 3, F.lit(1 << 30))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    after = F.substr(url, F.instr(url, "://") + 3, F.lit(1 << 30))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def candidate_keys(host: Column, path: Column, shapes: Sequence[tuple[int, int]]) -> Column:
    """The keys of a url in the given shapes."""
    labels = F.size(F.split(host, r"\."))
    keys = [F.when((host != "") & (labels >= n) & (F.length(path) >= m), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, m))) for n, m in shapes]
    return F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row of pages.

    rules: columns host, path (a prefix; null counts as empty) and verdict (block or allow).
    A url that no rule fits gets `default`. Reads pages once for the key universe and once to judge.
    """
    path = F.coalesce("path", F.lit(""))
    rules = rules.where("host is not null").select(F.concat("host", path).alias("key"), F.size(F.split("host", r"\.")).alias("n"), F.length(path).alias("m"), "verdict")
    shapes = sorted((r["n"], r["m"]) for r in rules.select("n", "m").distinct().collect())  # as many as rule shapes, not rules
    rules = rules.groupBy("key").agg(F.max(F.col("verdict") == "block").alias("block"))
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parts = pages.select(*keep, url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    keys = candidate_keys(F.col("host"), F.col("path"), shapes)
    universe = parts.select(F.explode(keys).alias("key"))
    block = build_cascade(rules.where("block").select("key"), universe, 1000)
    allow = build_cascade(rules.where("not block").select("key"), universe, 2000)
    blocked = lambda k: member(k, block) if block else F.lit(False)
    allowed = lambda k: member(k, allow) if allow else F.lit(False)
    entry = lambda k, block: F.struct(F.length(k).alias("len"), F.lit(block).alias("block"), k.alias("key"))
    best = F.array_max(F.transform(keys, lambda k: F.when(blocked(k), entry(k, True)).when(allowed(k), entry(k, False))))
    own = "_best" + "_" * max(map(len, parts.columns))  # no input column has this name
    verdict = F.when(F.col(own).isNull(), F.lit(default)).when(F.col(own)["block"], F.lit("block")).otherwise(F.lit("allow"))
    return parts.withColumn(own, best).select(*parts.columns, F.col(own)["key"].alias("rule"), verdict.alias("verdict"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages with its host, path, rule and verdict."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


OP1_SQL = r"""
WITH p AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(h, q, v)),
m AS (
  SELECT host, path, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
  GROUP BY host, path)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path
"""
