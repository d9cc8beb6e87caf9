"""BPE encoding and decoding with segment trees over adjacent pair ranks.

A word starts as one symbol for each byte. A segment tree has a leaf for each symbol that holds
rank and place of the pair it makes with the next one, so its root is the leftmost pair of lowest
rank. Merging it changes three leaves (its own, the one taken in, the one before), each in
logarithmic time, until the root says that no pair can be merged. Trees of many words of like length
are worked on side by side in arrays; single long words have a tree of their own.

Words repeat, so each task keeps what it has found, in a table of bounded size that is emptied when
full: that changes nothing but speed. Whole texts are encoded, whatever their length.

Defined results: a null text counts as empty: no tokens, and the digests of empty strings. Repeated
rows, ids and null ids are kept as they are. The input's other columns aren't kept by `encode_table`.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from larkgrid.llm.common import lean, remembered, table, text_chunks

#: Words that a task remembers, and bytes of text that it splits at once.
KEEP_WORDS, CHUNK_BYTES = 600_000, 1 << 20
#: Fewer words than this of one size have single trees.
SIDE_BY_SIDE = 8
NONE = np.int64(1) << 62

#: White space, as Unicode has it, and letters of the Latin blocks (there \p{N} is 0-9 only).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LATIN = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
#: The patterns that split text into words, for the two kinds of vocabulary.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+"
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
BEYOND_LATIN = re.compile(f"[^\\x00-\\x7f{LATIN[6:]}]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in own}
    for b in range(256):
        letters.setdefault(b, chr(256 + b - sum(x < b for x in own)))
    return [letters[b] for b in range(256)]


class Vocabulary:
    """A tokenizer file of the `tokenizers` library: a byte-level BPE model, with or without word ends."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        end = model["end_of_word_suffix"] or ""
        kinds = {n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])}
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        split = WORD_SPLIT if end else BYTE_SPLIT
        self.fast = re.compile(split.format(L=LATIN, N="0-9", S="\\t-\\r ")).findall
        self.full = regex.compile(split.format(L="\\p{L}", N="\\p{N}", S=SPACE)).findall
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters = byte_letters()
        self.first = np.array([self.ids[x] for x in letters], dtype=np.int64)
        self.last = np.array([self.ids[x + end] for x in letters], dtype=np.int64)
        a, b, made = (np.array(x, dtype=np.int64) for x in zip(*((self.ids[x], self.ids[y], self.ids[x + y]) for x, y in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])), strict=True))
        keys = a << 20 | b
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.pairs = dict(zip(keys.tolist(), range(len(keys)), strict=True))

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()  # letter by letter, without the final form
        return (self.full if BEYOND_LATIN.search(text) else self.fast)(text)

    def parts(self, text: str) -> list[str]:
        """Words and special tokens, in order."""
        if not self.specials or not self.specials.search(text):
            return self.words(text)
        out = []
        for x in self.specials.split(text):
            out += [x] if x in self.special else self.words(x)
        return out

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where they don't merge."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge_one(self, data: bytes) -> list[int]:
        """One word, with a tree of its own."""
        n = len(data)
        ids = [*self.first[list(data[:-1])].tolist(), int(self.last[data[-1]])]
        size = 1 << max(0, n - 1).bit_length()
        big, get, made = int(NONE), self.pairs.get, self.made
        tree = [big] * (2 * size)
        for i in range(n - 1):
            if (r := get(ids[i] << 20 | ids[i + 1])) is not None:
                tree[size + i] = r * size + i
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]

        def put(leaf: int, value: int) -> None:
            k = size + leaf
            tree[k] = value
            while k > 1:
                k >>= 1
                now = tree[2 * k] if tree[2 * k] < tree[2 * k + 1] else tree[2 * k + 1]
                if tree[k] == now:
                    break
                tree[k] = now

        while size > 1 and tree[1] < big:
            r, i = divmod(tree[1], size)
            j = after[i]
            ids[i], ids[j] = int(made[r]), -1
            k = after[i] = after[j]
            put(j, big)
            if k < n:
                before[k] = i
            r = get(ids[i] << 20 | ids[k]) if k < n else None
            put(i, big if r is None else r * size + i)
            if (p := before[i]) >= 0:
                r = get(ids[p] << 20 | ids[i])
                put(p, big if r is None else r * size + p)
        return [x for x in ids if x >= 0]

    def merge_many(self, words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of at most `size` bytes (a power of two over 1), with trees side by side: all ids, and how many of each."""
        n = np.array([len(w) for w in words], dtype=np.int32)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        rows = np.repeat(np.arange(len(words)), n)
        cols = np.arange(len(data)) - np.repeat(np.cumsum(n) - n, n)
        wide, double, shift = size + 1, 2 * size, size.bit_length() - 1
        ids = np.full(len(words) * wide, -1, dtype=np.int64)
        ids[rows * wide + cols] = np.where(cols == n[rows] - 1, self.last[data], self.first[data])
        tree = np.full((len(words), double), NONE)
        inner = cols < n[rows] - 1
        rows, cols = rows[inner], cols[inner]
        at = rows * wide + cols
        rank = self.rank(ids[at], ids[at + 1])
        tree[rows, size + cols] = np.where(rank < NONE, rank << shift | cols, NONE)
        for k in range(shift - 1, -1, -1):
            tree[:, 1 << k : 2 << k] = np.minimum(tree[:, 2 << k : 4 << k : 2], tree[:, (2 << k) + 1 : 4 << k : 2])
        tree = tree.ravel()
        after = np.tile(np.arange(1, size + 2, dtype=np.int32), len(words))
        before = np.tile(np.arange(-1, size, dtype=np.int32), len(words))
        live = np.arange(len(words))
        while True:
            root = tree[live * double + 1]
            going = root < NONE
            if not going.all():
                live, root = live[going], root[going]
            if not len(live):
                break
            base, trunk, end = live * wide, live * double, n[live]
            i, r = root & (size - 1), root >> shift
            j = after[base + i]
            k = after[base + j]
            made = self.made[r]
            ids[base + i], ids[base + j], after[base + i] = made, -1, k
            p = before[base + i]
            right, left = np.flatnonzero(k < end), np.flatnonzero(p >= 0)
            before[base[right] + k[right]] = i[right]
            # the pairs with the symbols after and before, ranked together
            rank = self.rank(np.concatenate([made[right], ids[base[left] + p[left]]]), np.concatenate([ids[base[right] + k[right]], made[left]]))
            place = np.concatenate([i[right], p[left]])
            value = np.where(rank < NONE, rank << shift | place, NONE)
            own = trunk + size
            tree[own + j] = NONE
            tree[own + i] = NONE
            tree[own[right] + i[right]] = value[: len(right)]
            tree[own[left] + p[left]] = value[len(right) :]
            trunk, node = np.concatenate([trunk, trunk, trunk[left]]), np.concatenate([j, i, p[left]]) + size
            for _ in range(shift):
                node = node >> 1
                child = trunk + 2 * node
                tree[trunk + node] = np.minimum(tree[child], tree[child + 1])
        kept = ids >= 0
        return ids[kept], kept.reshape(-1, wide).sum(axis=1)

    def merge(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        out, classes = {}, {}
        for w in words:
            if w in self.special:
                out[w] = self.special[w].to_bytes(4, "little")
            else:
                data = w.encode("utf-8", "replace")
                group = classes.setdefault((len(data) - 1).bit_length(), ([], []))
                group[0].append(w)
                group[1].append(data)
        for bits, (group, datas) in classes.items():
            size = max(2, 1 << bits)
            if len(group) < SIDE_BY_SIDE or size > 4096:
                out.update((w, np.array(self.merge_one(data)).astype("<u4").tobytes()) for w, data in zip(group, datas, strict=True))
                continue
            step = max(64, (1 << 19) // size)
            for k in range(0, len(group), step):
                ids, n = self.merge_many(datas[k : k + step], size)
                buf, ends = ids.astype("<u4").tobytes(), [0, *(4 * np.cumsum(n)).tolist()]
                out.update(zip(group[k : k + step], [buf[a:b] for a, b in zip(ends, ends[1:], strict=False)], strict=True))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """As the library decodes with no decoder set: tokens with blanks between them."""
        return " ".join(self.tokens[i] for i in ids)


class Encoder:
    """Encodes texts in one task, remembering words."""

    def __init__(self, vocabulary: Vocabulary, decode: bool = False):
        self.vocabulary, self.decode = vocabulary, decode
        self.ids: dict[str, bytes] = {}
        self.texts: dict[str, bytes] = {}

    def __call__(self, texts: Iterable[str]) -> Iterator[tuple[bytes, bytes]]:
        """Ids as little-endian unsigned 32-bit integers and, if asked for, the decoded text."""
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= CHUNK_BYTES:
                yield from self._chunk(held)
                held, size = [], 0
        yield from self._chunk(held)

    def _chunk(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        parts = [self.vocabulary.parts(t) for t in texts]
        if len(self.ids) > KEEP_WORDS:
            self.ids.clear()
            self.texts.clear()
        new = set().union(*parts).difference(self.ids)
        merged = self.vocabulary.merge(new)
        self.ids.update(merged)
        if self.decode:
            self.texts.update((w, self.vocabulary.decode(np.frombuffer(ids, dtype="<u4").tolist()).encode()) for w, ids in merged.items())
        for words in parts:
            yield b"".join(map(self.ids.__getitem__, words)), b" ".join(map(self.texts.__getitem__, words)) if self.decode else b""


@lru_cache(maxsize=2)
def vocabulary_of(text: str) -> Vocabulary:
    return Vocabulary(text)


_encoders: dict[tuple[int, bool], Encoder] = {}


def encoder(spec: str, decode: bool = False) -> Encoder:
    """This Python worker's encoder for a vocabulary; what it remembers serves its later tasks too."""
    key = (hash(spec), decode)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary_of(spec), decode)
    return _encoders[key]


def drop_encoders() -> None:
    _encoders.clear()
    vocabulary_of.cache_clear()


remembered["bpe"] = drop_encoders


def read_vocabulary(path: str) -> str:
    """The tokenizer file, read on the driver; it is a fixed file of a few MB and goes out as a broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_table(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """Per row: id, n_tokens, ids (binary, little-endian unsigned 32-bit) and decoded text, or their digests if not full.

    The id column keeps its name unless that is the name of another result column; then it is `id`.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    kind = docs.schema[id_col].dataType.simpleString()
    own = "ids binary, decoded string" if full else "ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value, True)
        for b in text_chunks(batches, 1):
            n, ids, texts = [], [], []
            for i, t in enc(x or "" for x in b.column(1).to_pylist()):
                n.append(len(i) // 4)
                ids.append(i if full else hashlib.sha256(i).hexdigest())
                texts.append(t.decode() if full else hashlib.sha256(t).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary() if full else pa.string()), pa.array(texts, pa.string())], ["id", "n_tokens", "ids" if full else "ids_sha256", "decoded" if full else "decoded_sha256"])

    out = docs.select(id_col, text_col).mapInArrow(lean(run, "bpe"), f"id {kind}, n_tokens bigint, {own}")
    return out if id_col in out.columns else out.withColumnRenamed("id", id_col)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens, digest of ids and digest of the decoded text."""
    import public_tokenizers

    return encode_table(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), full=False)
