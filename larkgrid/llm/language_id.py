"""Language identification of mixed texts: script ranges, per-word scores and a Viterbi pass.

The script of a word's letters narrows the languages that it may be in, to those that used the script
in training. A word's score in a language is the sum of smoothed log frequencies of its letter
triples, relative to the best language and cut off at CUT. The Viterbi path over a text's words pays
SWITCH for each change of language; its runs are the spans. A text's language is the one with most
letters in its spans, ties to the lesser name; the score is its share of letters.

A text whose best single language is beaten nowhere by as much as a switch costs has a constant path,
which a running maximum finds for many texts at once. Only the others are stepped through, side by side.

Training takes a bounded sample of rows (TRAIN), spread by hash; prediction covers whole texts.

Defined results: null texts and texts without a letter are `und` with score 0, and so is everything if
nothing could be learned. Words longer than any other count whole. Repeated rows and ids stay.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkgrid.llm.common import cut, split_mod4, table, text_chunks

#: Training rows at most, all languages together.
TRAIN = 6000
#: Buckets of letter triples; most that one word can say against a language; cost of a change of language.
BUCKETS, CUT, SWITCH = 1 << 16, 6.0, 14.0
#: A language uses a script if so much of its letters in training were in it.
SCRIPT_SHARE = 0.01

#: First code points of script ranges; each lasts to the next. 0 is Latin and what is left over.
SCRIPTS = [(0x0000, 0), (0x0370, 1), (0x0400, 2), (0x0530, 3), (0x0590, 4), (0x0600, 5), (0x0900, 6), (0x0980, 7), (0x0E00, 8), (0x10A0, 9), (0x1100, 10), (0x1200, 11), (0x1E00, 0), (0x1F00, 1), (0x2000, 0), (0x3040, 12), (0x3100, 13), (0x3130, 10), (0x3200, 13), (0xAC00, 10), (0xF900, 13), (0xFB00, 0), (0xFB1D, 4), (0xFB50, 5), (0xFF00, 0), (0x20000, 13)]


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def script_of(points: np.ndarray) -> np.ndarray:
    starts, kinds = (np.array(x) for x in zip(*SCRIPTS, strict=True))
    return kinds[np.searchsorted(starts, points, side="right") - 1]


@dataclass
class Words:
    """The distinct words of some texts as letter triples: bucket and word of each, and letters and script by word."""

    bucket: np.ndarray
    word: np.ndarray
    n_letters: np.ndarray
    script: np.ndarray


def split_words(words: list[str]) -> Words:
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    is_letter = letters()[points]
    blank = points == 32
    word = np.cumsum(blank) - 1
    low = np.where(is_letter, points, 0)
    triple = low[:-2] * 1_000_003 + low[1:-1] * 8191 + low[2:] * 131
    triple ^= triple >> 15
    at = np.flatnonzero(is_letter[1:-1])
    n = np.bincount(word[1:-1][at], minlength=len(words))
    script = np.zeros(len(words), dtype=np.int64)
    script[word[1:-1][at]] = script_of(points[1:-1][at])
    return Words((triple[at] * 40503 >> 4) % BUCKETS, word[1:-1][at], n, script)


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """For each text, where its words end; each word's place among the distinct ones; and those."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    flat = pc.list_flatten(lists).dictionary_encode()
    return np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary.to_pylist()


@dataclass
class Model:
    names: list[str]
    #: by triple bucket and language
    log_share: np.ndarray
    #: by script and language
    uses: np.ndarray

    def word_scores(self, words: Words) -> np.ndarray:
        """Of each distinct word in each language: 0 in the best, down to -CUT; languages of other scripts get -CUT."""
        n = len(words.n_letters)
        s = np.stack([np.bincount(words.word, weights=self.log_share[words.bucket, j], minlength=n) for j in range(len(self.names))], axis=1)
        may = self.uses[words.script]
        may = np.where(may.any(axis=1, keepdims=True), may, True)
        s = np.where(may, s, -np.inf)
        s = np.maximum(s - s.max(axis=1, keepdims=True), -CUT)
        s[words.n_letters == 0] = 0
        return s


def train(rows: DataFrame, text_col: str, lang_col: str) -> Model:
    """From rows with a text and a language. What comes back are triple counts, BUCKETS for each language at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, 0):
            langs = np.array(b.column(1).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                _, index, distinct = text_words(b.column(0).take(pa.array(np.flatnonzero(langs == lang))))
                w = split_words(distinct)
                times = np.bincount(index, minlength=len(distinct))
                count = np.bincount(w.bucket, weights=times[w.word], minlength=BUCKETS)
                scripts = np.bincount(w.script, weights=w.n_letters * times, minlength=64)
                key = np.concatenate([np.flatnonzero(count), BUCKETS + np.flatnonzero(scripts)])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(key, pa.int64()), pa.array(np.concatenate([count[count > 0], scripts[scripts > 0]]))], ["lang", "key", "n"])

    counted = rows.select(text_col, lang_col).mapInArrow(run, "lang string, key bigint, n double").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    got = counted.toArrow()
    names = sorted(set(got.column("lang").to_pylist()))
    total, uses = np.zeros((BUCKETS, len(names))), np.zeros((64, len(names)))
    lang = np.array([names.index(x) for x in got.column("lang").to_pylist()], dtype=np.int64)
    key, n = got.column("key").to_numpy(), got.column("n").to_numpy()
    low = key < BUCKETS
    total[key[low], lang[low]] = n[low]
    uses[key[~low] - BUCKETS, lang[~low]] = n[~low]
    smooth = total + 0.5
    share = uses / np.maximum(1, uses.sum(axis=0))
    return Model(names, np.log(smooth / smooth.sum(axis=0)), share >= SCRIPT_SHARE)


def viterbi(scores: np.ndarray, ends: np.ndarray, switch: float) -> np.ndarray:
    """The language of each word of each text: scores by word and language, texts end at `ends`."""
    n, k = scores.shape
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    sizes = ends - starts
    some = np.flatnonzero(sizes)
    path = np.zeros(n, dtype=np.int64)
    if not len(some) or k < 2:
        return path
    best = np.add.reduceat(scores, starts[some], axis=0).argmax(axis=1)
    of = np.repeat(np.arange(len(some)), sizes[some])
    path[:] = best[of]
    mine = scores[np.arange(n), path]
    others = scores.copy()
    others[np.arange(n), path] = -np.inf
    gain = others.max(axis=1) - mine
    # the best run of words against the best language, by texts; texts are kept apart by a drop between them
    drop = np.abs(gain).sum() * 2 + 1
    level = np.cumsum(gain) - of * drop
    before = np.minimum.accumulate(np.concatenate([[0.0], level[:-1]]) - np.where(np.diff(of, prepend=0) > 0, drop, 0))
    best_run = np.maximum.reduceat(level - before, starts[some])
    hard = some[best_run >= switch * 0.999]
    hard = hard[np.argsort(-sizes[hard], kind="stable")]
    if len(hard):
        h_start, h_size = starts[hard], sizes[hard]
        back = np.zeros((int(h_size.sum()), k), dtype=np.min_scalar_type(k))
        row0 = np.concatenate([[0], np.cumsum(h_size)[:-1]])
        value = scores[h_start].copy()
        live = len(hard)
        for t in range(1, int(h_size[0])):
            live = int(np.searchsorted(-h_size, -t, side="left"))
            v = value[:live]
            top = v.argmax(axis=1)
            moved = v[np.arange(live), top] - switch
            change = moved[:, None] > v
            back[row0[:live] + t] = np.where(change, top[:, None], np.arange(k))
            value[:live] = np.where(change, moved[:, None], v) + scores[h_start[:live] + t]
        at = value.argmax(axis=1)
        for t in range(int(h_size[0]) - 1, -1, -1):
            live = int(np.searchsorted(-h_size, -t, side="left"))
            path[h_start[:live] + t] = at[:live]
            if t:
                at[:live] = back[row0[:live] + t, at[:live]]
    return path


def label(model: Model, texts: pa.Array) -> list[tuple[str, float, list[dict]]]:
    """Language, score and spans (first and last word, language) of each text."""
    ends, index, distinct = text_words(texts)
    w = split_words(distinct)
    scores = model.word_scores(w)[index] if len(index) else np.zeros((0, max(1, len(model.names))))
    path = viterbi(scores, ends, SWITCH) if model.names else np.zeros(len(index), dtype=np.int64)
    n_letters = w.n_letters[index] if len(index) else np.zeros(0, dtype=np.int64)
    out, a = [], 0
    for b in ends.tolist():
        by = np.bincount(path[a:b], weights=n_letters[a:b], minlength=max(1, len(model.names)))
        if not model.names or not by.sum():
            out.append(("und", 0.0, []))
        else:
            turns = np.flatnonzero(np.diff(path[a:b])) + 1
            first = [0, *turns.tolist()]
            last = [*(turns - 1).tolist(), b - a - 1]
            best = int(by.argmax())
            out.append((model.names[best], float(by[best] / by.sum()), [{"first_word": x, "last_word": y, "lang": model.names[path[a + x]]} for x, y in zip(first, last, strict=True)]))
        a = b
    return out


def label_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """Per row: id, lang_pred, score and the spans (word numbers from 0, split at white space).

    The id column keeps its name unless that is the name of another result column; then it is `id`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers for each language
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, 1):
            got = label(shared.value, b.column(1))
            cols = [b.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([x[2] for x in got], span)] if spans else cols, ["id", "lang_pred", "score", "spans"][: 4 if spans else 3])

    more = ", spans array<struct<first_word:int,last_word:int,lang:string>>" if spans else ""
    out = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, lang_pred string, score double{more}")
    return out if id_col in out.columns else out.withColumnRenamed("id", id_col)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language; rows with remainder 2 are held out of training."""
    docs = table(spark, sf_dir, "documents")
    known = docs.where((split_mod4() != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = known.select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN).distinct()
    picked = cut(sample, "languages")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("t"))).alias("one")  # of several rows of one id, one
    rows = known.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "lang").agg(one).select(F.col("one.t").alias("text"), "lang")  # TRAIN rows at most
    model = train(rows, "text", "lang")
    out = label_languages(docs, model, spans=False)
    return out.select("doc_id", (split_mod4() == 2).alias("held_out"), "lang_pred", "score")
