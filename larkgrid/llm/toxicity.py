"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier.

1. Voters. A lexicon voter is a word or stem (first letters of words) that votes where it occurs in so many
   different words; a fixed list of insults votes too, and pattern voters look at letters, signs and lines.
   The training rows' labels draw up the lexicon.
2. Label model. Whether a text is toxic is hidden; each voter fires with one chance if it is and with
   another if not. These chances are estimated by expectation maximisation. The label that a row was given is one
   more voter, which may err like the others and with which the estimate begins: from a count of votes alone it
   settles on other traits that voters share, such as the language (area under the curve 0.45 on held-out rows).
   Voters that agree beyond what the hidden label explains are correlated; correlations are estimated in every
   round, and each voter's say is divided by one plus the sum of its own.
3. A linear classifier with logistic loss is trained on the posterior labels, over stems, words and
   patterns, and scores every whole text.

Training takes a bounded sample of labelled rows (TRAIN), spread by hash; scoring covers everything.

Defined results: a null or empty text has no features, so its score is the classifier's base rate.
Without labelled rows, or with labels of one kind only, every score is that kind's share (0 if none).
Repeated rows and ids stay; several labels of one row count as toxic if one of them does.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkgrid.llm.common import cut, discard, lean, split_mod4, table, text_chunks

#: Labelled rows at most; stems that become features, and those that become voters, at most.
TRAIN, FEATURES, VOTERS = 12_000, 3000, 150
#: Rows of the sample that a stem must occur in.
MIN_ROWS = 5
THRESHOLD = 0.3
#: Lengths of stems; numbers of different words with a stem that are features of their own.
STEMS, TIMES = (5, 6, 7, 8), (1, 2, 4)
#: Words that a task remembers as having none of the features.
KEEP_WORDS = 150_000

WORDS = re.compile(r"[^\W\d_]+").findall
#: A seed lexicon of common insults; it is one voter, and a second one if several occur.
INSULTS = frozenset("arsehole arschloch asshole bastard bitch clown connard cretin depp disgusting dumb dummkopf estupido filth fool idiot idiota idiote imbecile jerk loser moron pathetic scum stupid trash trottel ugly vermin worthless".split())
#: Pattern voters by name; each says whether a text shows the pattern.
PATTERNS = ["shouting", "exclamations", "signs", "second_person", "repeated_lines", "short", "insult", "insults"]

#: Which side a pattern voter is counted for at first.
PATTERN_SIDES = {p: int(p in ("insult", "insults")) for p in PATTERNS}
#: Correlations less than this are taken as none; voters with more than that are copies of each other in the first count.
CORRELATED, COPIES = 0.1, 0.8


def patterns_of(text: str, words: set[str]) -> list[bool]:
    n = max(1, len(text))
    capitals = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lines = text.split("\n")
    insults = len(INSULTS.intersection(words))
    return [
        capitals > 0.4 * n,
        text.count("!") > 0.01 * n,
        sum(map(text.count, "#$%&*@")) > 0.03 * n,
        any(f" {w} " in text for w in ("you", "your", "du", "tu", "vous", "usted")),
        len(lines) > 3 and len(set(lines)) < 0.6 * len(lines),
        n < 100,
        insults > 0,
        insults > 1,
    ]


def stems_of(word: str) -> list[str]:
    """What a word counts for: itself, and its first letters."""
    return [f"={word}", *(word[:n] for n in STEMS if len(word) > n)]


def found_in(text: str, known: Callable[[str], Iterable[str]]) -> list[str]:
    """The features of a text: stems with the least number of different words that have them; `known` gives those of a word."""
    n: dict[str, int] = {}
    for w in set(WORDS(text.lower())):
        for x in known(w):
            n[x] = n.get(x, 0) + 1
    return [f"{x} {k}" for x, c in n.items() for k in TIMES if c >= k]


def chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for b in text_chunks(batches, column):
        yield b, [x or "" for x in b.column(column).to_pylist()]


class KnownStems:
    """The stems of a word that are features; most words have none and are remembered as such."""

    def __init__(self, features: Iterable[str]):
        self.stems = {f.rpartition(" ")[0] for f in features}
        self.hits: dict[str, list[str]] = {}
        self.seen: set[str] = set()

    def features(self, texts: list[str]) -> Iterator[tuple[list[str], list[bool]]]:
        """Of each text: the features that are known, and the patterns."""
        words = [set(WORDS(t.lower())) for t in texts]
        if len(self.seen) > KEEP_WORDS:
            self.seen.clear()
            self.hits.clear()
        new = set().union(*words) - self.seen
        self.seen |= new
        for w in new:
            if got := self.stems.intersection(stems_of(w)):
                self.hits[w] = sorted(got)
        known = self.hits.keys()
        for t, own in zip(texts, words, strict=True):
            n: dict[str, int] = {}
            for w in known & own:
                for x in self.hits[w]:
                    n[x] = n.get(x, 0) + 1
            yield [f"{x} {k}" for x, c in n.items() for k in TIMES if c >= k], patterns_of(t, own)


@dataclass
class Classifier:
    features: dict[str, int]
    weights: np.ndarray
    base: float

    def scorer(self) -> Callable[[list[str]], list[float]]:
        """A function that scores texts: the base and the weights of a text's features and patterns."""
        stems, pattern = KnownStems(self.features), self.weights[len(self.features) :]

        def scores(texts: list[str]) -> list[float]:
            sums = [self.base + sum(self.weights[self.features[f]] for f in sorted(found) if f in self.features) + (float(pattern @ shown) if t else 0.0) for t, (found, shown) in zip(texts, stems.features(texts), strict=True)]
            return (1 / (1 + np.exp(-np.clip(np.array(sums), -30, 30)))).tolist()

        return scores


def independence(rest: np.ndarray, least: float) -> np.ndarray:
    """One divided by one plus the sum of its correlations, of `least` or more, with the other columns, for each column."""
    spread = np.sqrt((rest * rest).mean(axis=0)) + 1e-9
    rho = np.abs(rest.T @ rest) / len(rest) / np.outer(spread, spread)
    np.fill_diagonal(rho, 0)
    return 1 / (1 + np.where(rho < least, 0, rho).sum(axis=0))


def label_model(votes: np.ndarray, toward: np.ndarray, share: float, rounds: int = 40, given: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chance that each row is toxic; chances that each voter fires on toxic rows and on others.

    votes: rows by voters, true where one fires; toward: 1 for a voter that speaks for toxicity, -1 for one that
    speaks against it, 0 for one whose side is not known; share: of toxic rows, about. In the first count voters
    that are copies of each other share one vote. given: labels of the rows, a voter that is believed at first.
    """
    v = votes.astype(np.float64)
    count = np.round(v @ (toward * independence(v - v.mean(axis=0), COPIES)), 9)
    edge = np.sort(count)[::-1][min(len(count) - 1, int(share * len(count)))]
    q = np.where(count > edge, 0.95, np.where(count < edge, 0.05, share)) if given is None else np.where(given, 0.95, 0.05)
    fire1 = fire0 = np.zeros(v.shape[1])
    for r in range(rounds):
        total = q.sum(), (1 - q).sum()
        prior = np.clip(q.mean(), 1e-4, 1 - 1e-4)
        fire1, fire0 = (q @ v + 0.5) / (total[0] + 1), ((1 - q) @ v + 0.5) / (total[1] + 1)
        left = v - q[:, None] * fire1 - (1 - q)[:, None] * fire0  # what the hidden label leaves unexplained
        say = independence(left, CORRELATED)
        seen = (np.log(fire1) - np.log(fire0)) * say
        unseen = (np.log1p(-fire1) - np.log1p(-fire0)) * say
        odds = np.log(prior / (1 - prior)) + v @ seen + (1 - v) @ unseen
        if given is not None:
            right1, wrong0 = (q @ given + 2) / (total[0] + 2.2), ((1 - q) @ given + 0.2) / (total[1] + 2.2)
            odds += np.where(given, np.log(right1 / wrong0), np.log((1 - right1) / (1 - wrong0)))
        before, q = q, 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(q - before).max() < 1e-4:
            break
    return q, fire1, fire0


def fit_linear(rows: np.ndarray, cols: np.ndarray, n: int, d: int, target: np.ndarray, ridge: float = 0.3) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse zero-one features (rows, cols) by accelerated gradient steps."""
    w, base = np.zeros(d), float(np.log(np.clip(target.mean(), 1e-4, 1) / np.clip(1 - target.mean(), 1e-4, 1)))
    per_col = np.bincount(cols, minlength=d)
    per_row = np.bincount(rows, minlength=n)
    step = 1 / (0.25 * per_row[rows].astype(float) if len(rows) else np.ones(1))
    size = 1 / (np.bincount(cols, weights=1 / step, minlength=d) + ridge)  # a bound for each feature
    last = w.copy()
    for r in range(int(min(1500, max(300, 2e8 / max(1, len(rows)))))):
        look = w + (r / (r + 3)) * (w - last)
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights=look[cols], minlength=n) + base, -30, 30)))
        slope = np.bincount(cols, weights=(p - target)[rows], minlength=d) + ridge * look
        last, w = w, look - size * slope
        base -= 0.5 * float((p - target).mean()) / max(1e-6, float((p * (1 - p)).mean())) * 0.5
    return np.where(per_col > 0, w, 0), base


def learn(rows: DataFrame, text_col: str, label_col: str) -> Classifier:
    """From a bounded table of rows with a text and a label of 0 or 1. Counting is done on the executors."""
    rows = rows.select(text_col, F.col(label_col).cast("int"), F.monotonically_increasing_id())
    total = {r["y"]: r["n"] for r in rows.toDF("t", "y", "row").groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    if not n1 or not n0:
        return Classifier({}, np.zeros(len(PATTERNS)), 30.0 if n1 else -30.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in chunks(batches, 0):
            n: dict[str, list[int]] = {}
            for t, y in zip(texts, b.column(1).to_pylist(), strict=True):
                for w in found_in(t, stems_of):
                    n.setdefault(w, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array([x[0] for x in n.values()], pa.int64()), pa.array([x[1] for x in n.values()], pa.int64())], ["word", "n0", "n1"])

    words = rows.mapInArrow(lean(count), "word string, n0 bigint, n1 bigint").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= MIN_ROWS)
    # how far the odds are from even, in standard errors
    odds = F.log((F.col("n1") + 0.5) / (n1 - F.col("n1") + 0.5)) - F.log((F.col("n0") + 0.5) / (n0 - F.col("n0") + 0.5))
    error = F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    best = words.select("word", (odds / error).alias("z")).where(F.abs("z") >= 2).orderBy(F.abs("z").desc(), "word").limit(FEATURES).collect()
    features = {r["word"]: i for i, r in enumerate(best)}
    voters = [i for i, r in enumerate(best) if abs(r["z"]) > 3][:VOTERS]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems = KnownStems(features)
        for b, texts in chunks(batches, 0):
            found = [sorted([*(features[f] for f in own if f in features), *(len(features) + j for j, p in enumerate(shown) if p)]) for own, shown in stems.features(texts)]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(1), pa.array(found, pa.list_(pa.int32()))], ["row", "y", "found"])

    seen = rows.mapInArrow(lean(look), "row bigint, y int, found array<int>").orderBy("row").toArrow()  # TRAIN rows of small numbers
    found = seen.column("found").combine_chunks()
    cols = found.flatten().to_numpy().astype(np.int64)
    at = np.repeat(np.arange(len(seen)), np.asarray(found.value_lengths()))
    n, d = len(seen), len(features) + len(PATTERNS)
    place = np.full(d, -1)
    used = [*voters, *range(len(features), d)]
    place[used] = np.arange(len(used))
    votes = np.zeros((n, len(used)), dtype=bool)
    is_vote = place[cols] >= 0
    votes[at[is_vote], place[cols[is_vote]]] = True
    toward = np.array([np.sign(best[i]["z"]) for i in voters] + [PATTERN_SIDES[p] for p in PATTERNS])
    posterior, *_ = label_model(votes, toward, n1 / (n0 + n1), given=seen.column("y").to_numpy().astype(bool))
    weights, base = fit_linear(at, cols, n, d, posterior)
    return Classifier(features, weights, base)


def training_rows(docs: DataFrame, labels: DataFrame, text_col: str, condition=None) -> DataFrame:
    """text and toxic of at most TRAIN labelled rows, spread by hash."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    if condition is not None:
        marks = marks.where(condition)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("_toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN)
    marks = cut(marks, "labels")
    found = docs.select("doc_id", F.struct(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t")).alias("one")).join(F.broadcast(marks), "doc_id")  # TRAIN rows at most
    # of several rows of one id the one whose text has the least digest, so that rows are as few as ids
    return cut(found.groupBy("doc_id", "_toxic").agg(F.min("one").alias("one")).select(F.col("one.t").alias(text_col), "_toxic"), "labelled")


def score_texts(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """docs with a score of its text for every row, as `score`, which replaces a column of that name; all others stay."""
    keep = [c for c in docs.columns if c != "score"]
    docs = docs.select(keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES words
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = shared.value.scorer()
        for b, texts in chunks(batches, at):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores(texts), pa.float64())], [*keep, "score"])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score and prediction; rows with remainder 2 are held out of training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = training_rows(docs, table(spark, sf_dir, "labels"), "text", split_mod4() != 2)
    model = learn(rows, "text", "_toxic")
    discard(rows)
    out = score_texts(docs, model)
    return out.select("doc_id", (split_mod4() == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
