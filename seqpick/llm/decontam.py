"""Benchmark decontamination: Wu-Manber search for benchmark windows in whole documents.

The symbols are words. A pattern is a window of ten consecutive words of an item (an item of fewer,
but not none, is one pattern). For each pattern length one machine: a shift table over blocks of two
words says how far the search may skip when a block ends no pattern soon; where the shift is zero
the bucket of that suffix block and the window's first block holds the candidate patterns, and a
direct comparison of the words confirms them. Blocks are hashed and the tables are sorted arrays, as measured six bytes
for one of benchmark text and 25 while they are built; documents are cut into stretches that skip through the table together.

The machines of at most ``BLOCK_BYTES`` of items are broadcast; a larger benchmark is searched in blocks of that
size, one scan of the documents each, of which only the hits are written; they are joined to the documents by text.

Nulls and texts without words: no hits; such items have no windows. Items with a null id still mark
words, but are not named. Repeated documents are searched row by row; repeated items and windows count once.
A very long text is searched whole, alone in its slice. Empty tables: an empty result, or no hits.
Input columns named like a result column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, stage_table, text_slices, without

WINDOW = 10
#: Most bytes of benchmark text whose machines are broadcast at once.
BLOCK_BYTES = 16 << 20
SLICE = 4 << 20
#: Places of a document that one stretch of the search covers.
STRETCH = 256
#: Bytes of a word that are hashed for all words at once; longer words are hashed one by one.
LONG = 32
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after A-Z are lower-cased; all others become spaces.
TO_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
RESULT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TO_WORDS).split()


def windows(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if len(words) <= size:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


class Words:
    """The words of texts, as places in one buffer, with a 64-bit hash each. Text i has the words bounds[i] to bounds[i + 1] - 1."""

    def __init__(self, texts: list[bytes | None]):
        each = [(t or b"").translate(TO_WORDS) for t in texts]
        self.buffer = b" ".join(each)
        a = np.frombuffer(self.buffer, np.uint8)
        edge = np.flatnonzero(np.diff(np.r_[False, a != 0x20, False].astype(np.int8)))
        self.start, self.stop = edge[::2], edge[1::2]
        self.bounds = np.searchsorted(self.start, np.cumsum([0, *(len(t) + 1 for t in each)]))
        size = self.stop - self.start
        self.hash = size.astype(np.uint64)
        at = np.arange(len(size))
        with np.errstate(over="ignore"):
            for k in range(LONG):
                at = at[size[at] > k]
                if not len(at):
                    break
                self.hash[at] = (self.hash[at] ^ a[self.start[at] + k]) * np.uint64(0x9DDFEA08EB382D69)
        for i in at[size[at] > LONG].tolist():
            self.hash[i] = xxhash.xxh64_intdigest(self.buffer[self.start[i] : self.stop[i]], 7)

    def phrase(self, a: int, b: int) -> bytes:
        return b" ".join(self.buffer[self.start[a] : self.stop[b - 1]].split())


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a ^ (a >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + b
        return (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)


def _blocks(h: np.ndarray, block: int) -> np.ndarray:
    """The hash of the block that ends with each word."""
    return h if block == 1 or not len(h) else np.concatenate([h[:1], _mix(h[:-1], h[1:])])


class Machine:
    """Wu-Manber for patterns of one length over word symbols. ``items``: number and words, of ``length`` words at least."""

    def __init__(self, items: list[tuple[int, list[bytes]]], length: int):
        self.length, self.block = length, min(2, length)
        self.most = length - self.block + 1
        words = Words([b" ".join(ws) for _, ws in items])
        self.text, h, sizes = words.buffer, words.hash, np.diff(words.bounds)
        self.place = np.r_[words.start, len(self.text) + 1].astype(np.int32 if len(self.text) < (1 << 31) - 1 else np.int64)
        count = sizes - length + 1
        start = np.repeat(np.cumsum(sizes) - sizes, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item = np.repeat(np.array([k for k, _ in items], np.int32), count)
        ends = _blocks(h, self.block)
        self.keys, self.shift = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        for d in range(self.most):  # the least shift of a block comes first and stays
            new = np.setdiff1d(ends[start + length - 1 - d], self.keys)
            at = np.searchsorted(self.keys, new)
            self.keys, self.shift = np.insert(self.keys, at, new), np.insert(self.shift, at, d)
        # equal windows are one pattern, with the items of all
        whole = reduce(_mix, (h[start + j] for j in range(length)))
        _, first, pattern = np.unique(whole, return_index=True, return_inverse=True)
        if any((h[start + j] != h[start[first[pattern]] + j]).any() for j in range(length)):  # two windows have one hash
            _, first, pattern = np.unique([words.phrase(i, i + length) for i in start.tolist()], return_index=True, return_inverse=True)
        of = np.unique(np.stack([pattern.astype(np.int32), item]), axis=1)
        self.items, self.cuts = of[1], np.searchsorted(of[0], np.arange(len(first) + 1)).astype(np.int32)
        bucket = self._bucket(ends, start[first] + length)
        order = np.argsort(bucket, kind="stable")
        self.bucket, self.pattern, self.start = bucket[order], order.astype(np.int32), start[first].astype(self.place.dtype)

    def _bucket(self, ends: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The suffix block and the first block of windows that end before ``stop``."""
        return _mix(ends[stop - 1], ends[stop - self.length + self.block - 1])

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(end, pattern) of all occurrences."""
        ends = _blocks(words.hash, self.block)
        first, last = words.bounds[:-1] + self.length, words.bounds[1:]
        many = np.maximum(-(-(last - first + 1) // STRETCH), 0)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = np.repeat(first, many) + nth * STRETCH
        stop = np.minimum(at + STRETCH - 1, np.repeat(last, many))
        found = []
        while len(at) and len(self.keys):
            key = ends[at - 1]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            skip = np.where(self.keys[k] == key, self.shift[k], self.most)
            found.append(at[skip == 0])
            at = at + np.maximum(skip, 1)
            on = at <= stop
            at, stop = at[on], stop[on]
        end = np.concatenate([np.zeros(0, np.int64), *found])
        key = self._bucket(ends, end) if len(end) else np.zeros(0, np.uint64)
        lo, hi = np.searchsorted(self.bucket, key), np.searchsorted(self.bucket, key, "right")
        some = hi > lo
        hits = []
        for e, a, b in zip(end[some].tolist(), lo[some].tolist(), hi[some].tolist(), strict=True):
            have = words.phrase(e - self.length, e)
            for p in self.pattern[a:b].tolist():
                s = int(self.start[p])
                if have == self.text[self.place[s] : self.place[s + self.length] - 1]:
                    hits.append((e, p))
        got = np.array(hits, np.int64).reshape(-1, 2)
        return got[:, 0], got[:, 1]


def machines(items: list[tuple[int, bytes | None]], size: int = WINDOW) -> list[Machine]:
    by: dict[int, list[tuple[int, list[bytes]]]] = {}
    for k, text in items:
        if words := words_of(text):
            by.setdefault(min(len(words), size), []).append((k, words))
    return [Machine(some, n) for n, some in sorted(by.items())]


def occurrences(texts: list[bytes | None], model: list[Machine]) -> tuple[np.ndarray, np.ndarray, list[set[int]]]:
    """The words of each text as bounds, which of all words lie in an occurrence, and each text's items."""
    words = Words(texts)
    edge = np.zeros(len(words.start) + 1, np.int64)
    items: list[set[int]] = [set() for _ in texts]
    for m in model:
        end, pattern = m.search(words)
        np.add.at(edge, end - m.length, 1)
        np.add.at(edge, end, -1)
        for d, p in set(zip((np.searchsorted(words.bounds, end, "left") - 1).tolist(), pattern.tolist(), strict=True)):
            items[d].update(m.items[m.cuts[p] : m.cuts[p + 1]].tolist())
    return words.bounds, np.cumsum(edge[:-1]) > 0, items


def scan(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", text_col: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with RESULT columns: words, words in an occurrence of a window, and which items occur."""
    docs = without(docs, RESULT)
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null").distinct()
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-total // block_bytes))
    if passes == 1:
        return _one_pass(docs, [(r.item, r.text) for r in bench.toLocalIterator()], text_col, size)
    # hash blocks of items deal a large benchmark into passes
    one, two, hits, names, text = (free_name(docs.columns, x) for x in ("_t1", "_t2", "_hits", "_items", "_text"))
    keyed = docs.withColumn(text, F.col(text_col).cast("string")).withColumns({one: F.xxhash64(text_col), two: F.xxhash64(text_col, F.lit(1))})
    found = None
    for k in range(passes):
        part = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k)
        got = stage_table(_hits(keyed.select(F.col(one).alias("t1"), F.col(two).alias("t2"), F.col(text).alias("text")), [(r.item, r.text) for r in part.toLocalIterator()], size), "decontam")
        found = got if found is None else found.unionByName(got)
    flat = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    found = stage_table(found.groupBy(F.col("t1").alias(one), F.col("t2").alias(two)).agg(flat("hits").alias(hits), flat("names").alias(names)), "decontam")
    n_hit, n_items = (F.coalesce(F.size(F.col(c)), F.lit(0)).cast("long") for c in (hits, names))
    n_words = F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    sha = F.sha2(F.coalesce(F.array_join(F.array_sort(F.col(names)), ","), F.lit("")), 256)
    out = keyed.join(found, [one, two], "left").withColumns({"n_words": n_words, "n_hit": n_hit, "n_items": n_items, "items_sha256": sha, "contaminated": n_hit > 0})
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), *RESULT)


def _one_pass(docs: DataFrame, got: list[tuple[str | None, str]], text_col: str, size: int) -> DataFrame:
    whole = free_name(docs.columns, "_text")
    ids = [r[0] for r in got]
    model = docs.sparkSession.sparkContext.broadcast(machines([(i, r[1].encode()) for i, r in enumerate(got)], size))
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BooleanType()]
    schema = T.StructType([*docs.schema, *(T.StructField(c, k) for c, k in zip(RESULT, kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, whole, SLICE):
            bounds, hit, items = occurrences(texts, model.value)
            n_hit = np.diff(np.r_[0, np.cumsum(hit)][bounds])
            names = [{ids[i] for i in x if ids[i] is not None} for x in items]
            sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in names]
            new = [pa.array(np.diff(bounds)), pa.array(n_hit), pa.array(map(len, names), pa.int64()), pa.array(sha, pa.string()), pa.array(n_hit > 0)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=schema.names)

    return docs.withColumn(whole, F.col(text_col).cast("string")).mapInArrow(run, schema)


def _hits(texts: DataFrame, got: list[tuple[str | None, str]], size: int) -> DataFrame:
    """(t1, t2, hits, names) of the texts that have hits: the places of hit words, and the items."""
    ids = [r[0] for r in got]
    model = texts.sparkSession.sparkContext.broadcast(machines([(i, r[1].encode()) for i, r in enumerate(got)], size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, some in text_slices(batches, "text", SLICE):
            bounds, hit, items = occurrences(some, model.value)
            rows = [i for i, x in enumerate(items) if x]
            at = pa.array([np.flatnonzero(hit[bounds[i] : bounds[i + 1]]).tolist() for i in rows], pa.list_(pa.int32()))
            names = pa.array([sorted({ids[k] for k in items[i] if ids[k] is not None}) for i in rows], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(rows, pa.int64())) for c in (0, 1)), at, names], names=["t1", "t2", "hits", "names"])

    return texts.mapInArrow(run, "t1 long, t2 long, hits array<int>, names array<string>")
