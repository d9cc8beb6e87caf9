"""Secret scans with multipart credential linking (native DataFrame expressions only).

Base spans are found by three patterns. The span of a match is worked out inside the row: the text
is split by the pattern, so pieces and matches alternate, and running sums of their lengths are the
positions. The text itself is never moved; only the parts of texts that hold a weak candidate are.

Linking: a credential has an identifier, a secret and an endpoint. On its own, an endpoint or a long
token with no keyword beside it says little. Such weak candidates are reported only where
complementary parts lie near: a weak token needs an access identifier within `REACH` code points, an
endpoint needs both an access identifier and a secret (strong or weak). This is an interval join on
(text, scope of REACH code points): a part is offered to each scope that it may reach, a weak
candidate looks in all that it touches. Spans of one kind don't overlap, so what a scope holds is bounded.

Defined results: a null text counts as empty; an empty text has no spans, and base_sha256 is that of
the empty string. Rows are kept as they are, repeated ids and null ids included. Columns of the
input are kept by `scan_secrets` unless a result column has the same name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkgrid.llm.common import cut, numbered, table

#: The pattern of assignments and the least length of its value.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
LEAST_VALUE = 6
KINDS = ["assign", "access", "hex", "weak_token", "endpoint"]

#: Access identifiers of 20 letters and hexadecimal runs of 24. A match of `AKIA[A-Z0-9]+` or
#: `[0-9a-f]+` ends where its run does, so asking for the length in the pattern drops the same matches.
ACCESS_LONG = r"AKIA[A-Z0-9]{16,}"
HEX_LONG = r"[0-9a-f]{24,}"
#: Weak parts: 40 letters of base64 with no letter of it on either side, and addresses.
WEAK_TOKEN = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/-]*)?"
#: Matches of a text that are gone over at once.
BLOCK = 64
#: Code points between two parts of one credential, at most; also the size of a scope.
REACH = 200

SPAN = "struct<start:bigint,kind:int,end:bigint>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, begin: Column, after: Callable, emit: Callable, kind: str) -> Column:
    """emit(state, x) for each x of an array, state being begin, then after(state, x) of the one before.

    An array that grows in a fold is copied at each step, so folds go over blocks of BLOCK and over the blocks.
    """
    empty = lambda t: F.array().cast(f"array<{t}>")
    fold = lambda block, state: F.aggregate(block, state, after)

    def whole(xs: Column) -> Column:
        count = F.ceil(F.size(xs) / BLOCK).cast("int")
        blocks = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(xs, i * BLOCK + 1, BLOCK)))
        return let(blocks, by_blocks)

    def by_blocks(blocks: Column) -> Column:
        start = F.struct(begin.alias("at"), empty("bigint").alias("out"))
        states = F.aggregate(blocks, start, lambda acc, b: F.struct(fold(b, acc["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), states.alias("state")), lambda z: one(z["block"], z["state"])))

    def one(block: Column, state: Column) -> Column:
        start = F.struct(state.alias("at"), empty(kind).alias("out"))
        return F.aggregate(block, start, lambda acc, x: F.struct(after(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(emit(acc["at"], x))).alias("out")), lambda acc: acc["out"])

    return F.coalesce(let(items, whole), empty(kind))


def spans_of(text: Column, pattern: str, kind: int, least: Column | None = None) -> Column:
    """All leftmost non-overlapping matches as (start, kind, end); `least`: which of them to keep.

    pieces[i] and matches[i] alternate, so one pass that carries the position gives every span.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("bigint"))
    lengths = F.transform(matches, lambda m: F.length(m).cast("bigint"))
    steps = F.slice(F.arrays_zip(pieces.alias("gap"), lengths.alias("len")), F.lit(1), F.size(matches))  # the last piece has no match after it
    emit = lambda at, x: F.struct((at + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + x["gap"] + x["len"]).alias("end"))
    found = running(steps, F.lit(0).cast("bigint"), lambda at, x: at + x["gap"] + x["len"], emit, SPAN)
    if least is not None:
        found = F.transform(F.filter(F.arrays_zip(found.alias("s"), least.alias("ok")), lambda x: x["ok"]), lambda x: x["s"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> list[Column]:
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    return [
        spans_of(text, ASSIGN, 0, F.transform(values, lambda v: F.length(v) >= LEAST_VALUE)),
        spans_of(text, ACCESS_LONG, 1),
        spans_of(text, HEX_LONG, 2),
    ]


def as_text(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def scan_secrets(docs: DataFrame, text_col: str = "text", reach: int = REACH, keep: Sequence[str] | None = None) -> DataFrame:
    """Adds base (the base spans) and linked (reported weak candidates) to every row.

    keep: columns of the input that stay, all if not given. Without the text among them, texts are read once
    and spans are written; else they are read again for the result.
    Only rows with both a weak candidate and a part that could complete it take part in the join;
    they are keyed by the digest of their text, which makes equal texts one row of it.
    """
    names = {"base", "linked", "_key"}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(*keep, F.concat(*base_spans(text)).alias("base"), *([] if text_col in keep else [F.col(text_col).alias("_text")]))
    text = F.coalesce(F.col(text_col if text_col in keep else "_text"), F.lit(""))
    ids = lambda s: s["kind"] == 1
    weak = F.when(F.exists("base", ids), F.concat(_no_overlap(spans_of(text, WEAK_TOKEN, 3)), _no_overlap(spans_of(text, ENDPOINT, 4))))
    found = found.withColumn("_weak", weak).withColumn("_key", F.when(F.size("_weak") > 0, F.sha2(text, 256)))
    if text_col not in keep:
        found = cut(found.drop("_text"), "secret-spans")
    parts = found.where("_key is not null").select("_key", F.explode(F.concat("base", "_weak")).alias("s")).select("_key", "s.*").distinct()
    linked = link_parts(cut(parts, "secret-parts"), reach)
    # rows without a candidate get keys of their own, which spreads them; they match nothing
    own = F.concat(F.lit("none "), F.monotonically_increasing_id().cast("string"))
    out = found.withColumn("_key", F.coalesce("_key", own)).join(linked, "_key", "left")
    return out.select(*keep, "base", F.coalesce("linked", F.array().cast(f"array<{SPAN}>")).alias("linked"))


def _no_overlap(weak: Column) -> Column:
    """Weak spans that lie in a base span add nothing."""
    return F.filter(weak, lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))


def link_parts(parts: DataFrame, reach: int) -> DataFrame:
    """The weak parts of each key whose complements lie within reach, as `linked` by `_key`.

    parts: distinct _key, start, kind, end. A scope's offers are one row for each role, with as many
    spans as fit into three scopes at most.
    """
    role = F.when(F.col("kind") == 1, F.lit("id")).when(F.col("kind").isin(0, 2, 3), F.lit("secret"))
    scope = lambda c: F.floor(F.col(c) / reach)
    offers = parts.withColumn("role", role).where("role is not null")
    offers = offers.withColumn("scope", F.explode(F.sequence(scope("start") - 1, scope("end") + 1)))
    at = F.struct("start", "end")
    held = offers.groupBy("_key", "scope", "role").agg(F.sort_array(F.collect_set(at)).alias("at"))
    weak = parts.where(F.col("kind") >= 3).withColumn("scope", F.explode(F.sequence(scope("start"), scope("end"))))
    near = F.exists("at", lambda o: (o["start"] <= F.col("end") + reach) & (o["end"] >= F.col("start") - reach) & ((o["start"] != F.col("start")) | (o["end"] != F.col("end"))))
    met = weak.join(held, ["_key", "scope"]).where(near).groupBy("_key", "start", "kind", "end").agg(F.max(F.col("role") == "id").alias("id"), F.max(F.col("role") == "secret").alias("secret"))
    good = met.where(F.col("id") & ((F.col("kind") == 3) | F.col("secret")))
    return good.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("linked"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every reported span of its text replaced by a mark; a null text stays null."""
    text = f"_c{docs.columns.index(text_col)}"
    plain = numbered(docs)
    scanned = scan_secrets(plain, text)
    spans = F.array_sort(F.concat("base", "linked"))
    gap = lambda at, s: F.substr(F.col(text), (at + 1).cast("int"), F.greatest(s["start"] - at, F.lit(0)).cast("int"))
    parts = running(spans, F.lit(0).cast("bigint"), lambda at, s: F.greatest(at, s["end"]), lambda at, s: F.when(s["start"] >= at, F.concat(gap(at, s), F.lit(mark))).otherwise(F.lit("")), "string")
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    clean = F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ""), F.substr(F.col(text), (last + 1).cast("int"), F.lit(1 << 30)))).otherwise(F.col(text))
    return scanned.withColumn(text, clean).select(*plain.columns).toDF(*docs.columns)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts of base spans, their digest, and all spans."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(as_text(F.col("base")), 256).alias("base_sha256"),
        as_text(F.concat("base", "linked")).alias("spans"),
    )


