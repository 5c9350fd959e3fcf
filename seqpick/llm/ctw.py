"""Language-model scoring by context-tree weighting, binary-decomposed, without any broadcast model.

A text is coded as its words with one space between and a newline as the end. Each byte is eight
binary decisions; for each decision (the bits of the byte so far) there is a context tree over the
``DEPTH`` bytes before. A node estimates its bit by Krichevsky-Trofimov from its training counts, and
its weighted probability is half its own block probability plus half the product of its children's.
The trained tree predicts by the posterior weights of all depths on the path; below the last node
that training has seen, that node's estimate is kept.

Everything is exact and dealt out: documents lie in hash chunks of about ``CHUNK_BYTES``; a chunk sends its
distinct words and (context, byte) grams with training counts once, words are summed by word and
grams into the subtrees of their last two context bytes (at most 256^(DEPTH - 1) grams), and every
chunk gets back the scores of what it sent. Texts pass a task in slices of ``SLICE`` bytes, very long ones in
parts; what it holds are a chunk's distinct words and grams. Only the nodes of depths 0 and 1, at
most 65,536 rows, pass the driver.

Null and empty texts: no words, the end alone. A null id is in no fold, and so trains.
Repeated rows count as often as they stand. Without training rows all words are unknown, and each
bit is coded by one half. An empty table gives an empty result.
Other columns of the input are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, stage_table, text_slices, total_text_bytes

DEPTH = 5
#: Text of a chunk, the least number of chunks, and the most partitions that they are dealt into.
CHUNK_BYTES, CHUNKS, PARTITIONS = 32 << 20, 16, 8192
SLICE = 2 << 20
#: Rows of a batch that a task sends.
SEND = 1 << 16
FOLDS = 10
END = b"\n"


def coded(text: bytes | None) -> tuple[list[bytes], bytes]:
    """The words, and the coded text."""
    words = (text or b"").translate(LOWER).split()
    return words, b" ".join(words) + END


_SPACE = re.compile(rb"[ \t-\r]")


def parts(text: bytes | None, depth: int, most: int = SLICE) -> Iterator[tuple[list[bytes], bytes]]:
    """The coded text in parts of about ``most`` bytes: their words, and their bytes behind the ``depth`` bytes before them."""
    before, lead, at = END * depth, b"", 0
    while text is not None and len(text) - at > most:
        gap = _SPACE.search(text, at + most)
        if gap is None:
            break
        words = text[at : gap.start()].translate(LOWER).split()
        at = gap.end()
        if words:
            line = before + lead + b" ".join(words)
            yield words, line
            before, lead = line[-depth:], b" "
    words, line = coded(text[at:] if at else text)
    yield words, before + (lead if words else b"") + line


def _batches(texts: list[bytes | None], depth: int) -> Iterator[list[tuple[int, list[bytes], bytes]]]:
    """The parts of many texts, with the texts' numbers, in lists of about SLICE bytes."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for words, line in parts(t, depth):
            held.append((i, words, line))
            size += len(line)
            if size > SLICE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _keys(lines: list[bytes], depth: int) -> np.ndarray:
    """A key for each byte of lines behind its ``depth`` first: the bytes before, nearest first, and the byte last."""
    a = np.frombuffer(b"".join(lines), np.uint8)
    n = len(a)
    keep = np.ones(n, bool)
    starts = np.cumsum([0, *map(len, lines[:-1])])
    for k in range(depth):
        keep[starts + k] = False
    key = a[depth:].astype(np.int64)
    for j in range(1, depth + 1):
        key |= a[depth - j : n - j].astype(np.int64) << (8 * (depth + 1 - j))
    return key[keep[depth:]]


def grams(docs: list[bytes], depth: int) -> np.ndarray:
    """The keys of coded documents in turn, each begun behind ends."""
    return _keys([END * depth + d for d in docs], depth)


class Lookup:
    """Values of distinct grams in a table of open addresses, at most two thirds full."""

    def __init__(self, key: np.ndarray, value: np.ndarray, depth: int):
        self.depth, bits = depth, max(4, (len(key) * 3 // 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, value.dtype)
        at, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = left[self.key[at[left]] < 0]
            self.key[at[free]] = key[free]  # of several that want a slot the last one gets it
            won = self.key[at[left]] == key[left]
            self.value[at[left[won]]] = value[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def keys(self, key: np.ndarray) -> np.ndarray:
        at = self._slot(key)
        left = np.flatnonzero(self.key[at] != key)
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found = self.key[at[left]]
            if (found < 0).any():
                raise KeyError("a gram that was not sent")
            left = left[found != key[left]]
        return self.value[at]

    def of(self, docs: list[bytes]) -> np.ndarray:
        return self.keys(grams(docs, self.depth))


_TABLE = np.array([math.lgamma(i + 0.5) for i in range(64)])
_TABLE1 = np.array([math.lgamma(i + 1.0) for i in range(64)])


def _lgamma(n: np.ndarray, table: np.ndarray, plus: float) -> np.ndarray:
    """log Gamma(n + plus) of counts: a table below 64, Stirling's series above (error under 1e-13)."""
    x = n + plus
    y = np.maximum(x, 32.0)
    big = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return np.where(n < 64, table[np.minimum(n, 63)], big)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The log of the block probability of n0 zeros and n1 ones."""
    return _lgamma(n0, _TABLE, 0.5) + _lgamma(n1, _TABLE, 0.5) - _lgamma(n0 + n1, _TABLE1, 1.0) - math.log(math.pi)


class Level:
    """The nodes of one depth over sorted grams: ``node`` of each gram for each of the eight decisions."""

    def __init__(self, key: np.ndarray, n: np.ndarray, depth: int, d: int):
        ctx, sym = key >> (8 * (depth + 1 - d)), key & 255
        order = np.lexsort((sym, ctx)) if d < depth else np.arange(len(key))
        ctx, sym, n = ctx[order], sym[order], n[order]
        new = np.r_[True, ctx[1:] != ctx[:-1]]
        back = np.empty(len(key), np.int64)
        back[order] = np.arange(len(key))
        self.node, self.first, self.n0, self.n1 = [], [], [], []
        for t in range(8):
            pre = sym >> (8 - t)
            start = np.flatnonzero(new | np.r_[True, pre[1:] != pre[:-1]])
            at = np.cumsum(np.bincount(start, minlength=len(key))) - 1
            ones = np.add.reduceat(np.where((sym >> (7 - t)) & 1, n, 0), start)
            self.n1.append(ones)
            self.n0.append(np.add.reduceat(n, start) - ones)
            self.node.append(at[back])
            self.first.append(order[start])


def subtrees(key: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[Level, list[np.ndarray], list[np.ndarray]]:
    """Over sorted distinct grams: the level ``top``, and for each decision its nodes' log weighted probability and
    each gram's mixed probability of its own bit from depth ``top`` down (0 where training hasn't seen the node)."""
    mixed: list[np.ndarray] = [np.zeros(0)] * 8
    below_pw: list[np.ndarray] = [np.zeros(0)] * 8
    bits = [((key >> (7 - t)) & 1).astype(bool) for t in range(8)]
    below: Level | None = None
    for d in range(depth, top - 1, -1):
        level = Level(key, n, depth, d)
        for t in range(8):
            n0, n1, node = level.n0[t], level.n1[t], level.node[t]
            own = log_kt(n0, n1)
            p = (np.where(bits[t], n1[node], n0[node]) + 0.5) / (n0 + n1 + 1)[node]
            if below is None:
                pw, m = own, p
            else:
                kids = np.bincount(node[below.first[t]], below_pw[t], len(n0))
                pw = np.logaddexp(own, kids) - math.log(2)
                stay = (0.5 * np.exp(own - pw))[node]
                m = np.where(mixed[t] > 0, stay * p + (1 - stay) * mixed[t], p)
            seen = (n0 + n1)[node] > 0
            pw = np.where(n0 + n1 > 0, pw, 0.0)
            below_pw[t], mixed[t] = pw, np.where(seen, m, 0.0)
        below = level
    return below, below_pw, mixed


class Top:
    """Depths 0 and 1 from the rows (c1, prefix, n0, n1, kids): kids is the sum of log weighted probabilities at depth 2."""

    def __init__(self, rows: list[tuple[int, int, int, int, float]]):
        n = np.zeros((2, 256, 256), np.int64)
        kids = np.zeros((256, 256))
        for c, pre, n0, n1, k in rows:
            n[0, c, pre], n[1, c, pre], kids[c, pre] = n0, n1, k
        one = log_kt(n[0], n[1])
        pw1 = np.where(n.sum(0) > 0, np.logaddexp(one, kids) - math.log(2), 0.0)
        self.stay1, self.n = 0.5 * np.exp(one - pw1), n
        m = n.sum(1)
        zero = log_kt(m[0], m[1])
        pw0 = np.logaddexp(zero, pw1.sum(0)) - math.log(2)
        self.stay0, self.m = 0.5 * np.exp(zero - pw0), m

    def mix(self, c: np.ndarray, pre: np.ndarray, bit: np.ndarray, two: np.ndarray) -> np.ndarray:
        b = bit.astype(np.int64)
        p1 = (self.n[b, c, pre] + 0.5) / (self.n[0, c, pre] + self.n[1, c, pre] + 1)
        s1 = self.stay1[c, pre]
        one = np.where(two > 0, s1 * p1 + (1 - s1) * two, p1)
        p0 = (self.m[b, pre] + 0.5) / (self.m[0, pre] + self.m[1, pre] + 1)
        s0 = self.stay0[pre]
        return np.where(self.n[0, c, pre] + self.n[1, c, pre] > 0, s0 * p0 + (1 - s0) * one, p0)


def _prefix(key: np.ndarray, t: int) -> np.ndarray:
    """The decision: a leading 1 and the ``t`` bits of the byte before it."""
    return (1 << t) | ((key & 255) >> (8 - t))


def roots(key: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """(c1, prefix, n0, n1, log weighted probability) of every node at depth 2."""
    level, pw, _ = subtrees(key, n, depth, 2)
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    for t in range(8):
        k = key[level.first[t]]
        for a, v in zip(out, (k >> (8 * depth), _prefix(k, t), level.n0[t], level.n1[t], pw[t]), strict=True):
            a.append(v)
    return tuple(np.concatenate(a) for a in out)


def log10_grams(key: np.ndarray, n: np.ndarray, depth: int, top: Top) -> np.ndarray:
    """log10 of the probability of each gram's byte after its context."""
    _, _, mixed = subtrees(key, n, depth, 2)
    total = np.zeros(len(key))
    for t in range(8):
        total += np.log10(top.mix(key >> (8 * depth), _prefix(key, t), ((key >> (7 - t)) & 1).astype(bool), mixed[t]))
    return total


_SENT = pa.schema([("chunk", pa.int32()), ("gram", pa.int64()), ("token", pa.binary()), ("n", pa.int64())])


def _summed(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs of (key, n) as one: n summed by key."""
    if len(runs) == 1:
        return runs[0]
    key, n = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[start], np.add.reduceat(n, start)


class Counts:
    """What a chunk holds: its distinct grams and tokens, each with its count in training texts (0: elsewhere only)."""

    def __init__(self, chunk: int, depth: int):
        self.chunk, self.depth = chunk, depth
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.tokens: dict[bytes, int] = {}

    def add(self, texts: list[bytes | None], train: np.ndarray) -> None:
        count, get = self.tokens, self.tokens.get
        for batch in _batches(texts, self.depth):
            for fold in (True, False):
                some = [(w, line) for i, w, line in batch if train[i] == fold]
                if some:
                    u, n = np.unique(_keys([line for _, line in some], self.depth), return_counts=True)
                    self._merge(u, n if fold else np.zeros(len(u), np.int64))
                    for w, _ in some:
                        for x in w:
                            count[x] = get(x, 0) + fold
        count[END] = get(END, 0) + int(train.sum())

    def _merge(self, key: np.ndarray, n: np.ndarray) -> None:
        """Sorted runs, each over twice as long as the next."""
        some = [(key, n)]
        while self.runs and len(self.runs[-1][0]) <= 2 * sum(len(k) for k, _ in some):
            some.append(self.runs.pop())
        self.runs.append(_summed(some))

    def send(self) -> Iterator[pa.RecordBatch]:
        self.runs = [_summed(self.runs)]
        for key, n in self.runs:
            for at in range(0, len(key), SEND):
                g = key[at : at + SEND]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), self.chunk, np.int32)), pa.array(g), pa.nulls(len(g), pa.binary()), pa.array(n[at : at + SEND])], schema=_SENT)
        each = iter(self.tokens.items())
        while some := list(islice(each, SEND)):
            m = len(some)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, self.chunk, np.int32)), pa.nulls(m, pa.int64()), pa.array([w for w, _ in some], pa.binary()), pa.array([n for _, n in some], pa.int64())], schema=_SENT)


def _chunk_counts(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Counts of each chunk, from rows (chunk, held_out, text) in order of chunk."""
    held: Counts | None = None
    for part, texts in text_slices(batches, "text", SLICE):
        chunks = part.column("chunk").to_numpy()
        train = ~np.array(part.column("held_out").to_pylist(), bool)
        cuts = [0, *(np.flatnonzero(chunks[1:] != chunks[:-1]) + 1).tolist(), len(chunks)]
        for a, b in pairwise(cuts):
            if held is None or held.chunk != chunks[a]:
                if held is not None:
                    yield from held.send()
                held = Counts(int(chunks[a]), depth)
            held.add(texts[a:b], train[a:b])
    if held is not None:
        yield from held.send()


class Scorer:
    """The values that a chunk gets back, and the scores of its texts."""

    def __init__(self, chunk: int, depth: int, total: int, floor: float):
        self.chunk, self.depth, self.total, self.floor = chunk, depth, total, floor
        self.got: list[tuple[np.ndarray, np.ndarray]] = []
        self.logs: dict[bytes, float] = {}
        self.none = math.log10(0.1 / floor)
        self.look: Lookup | None = None

    def learn(self, part: pa.RecordBatch) -> None:
        isgram = part.column("gram").is_valid()
        some = part.filter(isgram)
        self.got.append((some.column("gram").to_numpy(), some.column("v").to_numpy()))
        words = part.filter(pa.compute.invert(isgram))
        c = words.column("v").to_numpy()
        self.logs.update(zip(words.column("token").to_pylist(), np.where(c > 0, np.log10((c + 0.1) / self.floor), self.none).tolist(), strict=True))

    def score(self, part: pa.RecordBatch, texts: list[bytes | None], schema: pa.Schema) -> pa.RecordBatch:
        if self.look is None:
            keys, values = (np.concatenate(x) for x in zip(*self.got, strict=True))
            self.got, self.look = [], Lookup(keys, values, self.depth)
        m, log = len(texts), self.logs.__getitem__
        n_tokens, unknown, size, base, own = (np.zeros(m, t) for t in (np.int64, np.int64, np.int64, float, float))
        for batch in _batches(texts, self.depth):
            lines = [line for _, _, line in batch]
            sizes = np.fromiter((len(x) - self.depth for x in lines), np.int64, len(lines))
            at = np.fromiter((i for i, _, _ in batch), np.int64, len(lines))
            np.add.at(own, at, np.add.reduceat(self.look.keys(_keys(lines, self.depth)), np.cumsum(sizes) - sizes))
            np.add.at(size, at, sizes)
            for i, w, _ in batch:
                logs = list(map(log, w))
                n_tokens[i] += len(w)
                base[i] += sum(logs)
                unknown[i] += logs.count(self.none)
        n_tokens += 1
        base += log(END)
        unknown += log(END) == self.none
        cols = [part.column("id"), part.column("held_out"), *map(pa.array, (n_tokens, n_tokens - unknown, np.full(m, self.total, np.int64), base, own, size, -own / math.log10(2) / size))]
        return pa.RecordBatch.from_arrays(cols, schema=schema)


def _chunk_scores(batches: Iterator[pa.RecordBatch], depth: int, total: int, floor: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Scores of the texts, from rows in order of (chunk, kind): values of grams and tokens first, then texts."""
    held: Scorer | None = None
    for part, texts in text_slices(batches, "text", SLICE):
        chunk, kind = (part.column(c).to_numpy() for c in ("chunk", "kind"))
        cuts = [0, *(np.flatnonzero((chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(chunk)]
        for a, b in pairwise(cuts):
            if held is None or held.chunk != chunk[a]:
                held = Scorer(int(chunk[a]), depth, total, floor)
            if kind[a]:
                yield held.score(part.slice(a, b - a), texts[a:b], schema)
            else:
                held.learn(part.slice(a, b - a))


def _by_context(table: DataFrame) -> DataFrame:
    """Grams sorted, with all of two last context bytes in one partition."""
    return table.repartition("two").sortWithinPartitions("gram").select("gram", "n")


def _whole_contexts(batches: Iterator[pa.RecordBatch], depth: int, least: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted grams and counts, in pieces that don't cut the grams of two last context bytes."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        size += b.num_rows
        if size >= least:
            k, n = (np.concatenate(x) for x in zip(*held, strict=True))
            two = k >> (8 * (depth - 1))
            cut = int(np.searchsorted(two, two[-1]))
            if cut:
                yield k[:cut], n[:cut]
            held, size = [(k[cut:], n[cut:])], len(k) - cut
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, folds: int = FOLDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, code_bytes, bits_per_byte) of every row."""
    spark = docs.sparkSession
    chunks = max(CHUNKS, -(-total_text_bytes(docs, text_col) // CHUNK_BYTES))
    ident, text = F.col(id_col), F.col(text_col).cast("string")
    held = F.coalesce(F.crc32(ident.cast("string").cast("binary")) % folds == 0, F.lit(False))
    chunk = F.pmod(F.xxhash64(ident, text), F.lit(chunks)).cast("int")
    rows = docs.select(chunk.alias("chunk"), ident.alias("id"), held.alias("held_out"), text.alias("text"))

    dealt = rows.select("chunk", "held_out", "text").repartitionById(min(chunks, PARTITIONS), "chunk").sortWithinPartitions("chunk")
    sent = stage_table(dealt.mapInArrow(lambda b: _chunk_counts(b, depth), "chunk int, gram long, token binary, n long"), "ctw-sent")

    two = F.shiftright("gram", 8 * (depth - 1)).alias("two")
    table = stage_table(sent.where("gram is not null").groupBy(two, "gram").agg(F.sum("n").alias("n")), "ctw-grams")
    words = sent.where("token is not null").groupBy("token").agg(F.sum("n").alias("c"))
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()

    def find_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, n in _whole_contexts(batches, depth):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in roots(k, n, depth)], names=["c", "pre", "n0", "n1", "kids"])

    upper = _by_context(table).mapInArrow(find_roots, "c long, pre long, n0 long, n1 long, kids double").groupBy("c", "pre").agg(*(F.sum(x) for x in ("n0", "n1", "kids")))
    top = spark.sparkContext.broadcast(Top([tuple(r) for r in upper.orderBy("c", "pre").collect()]))  # 256 * 255 rows at most

    def find_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, n in _whole_contexts(batches, depth):
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(log10_grams(k, n, depth, top.value))], names=["gram", "v"])

    scored = _by_context(table).mapInArrow(find_scores, "gram long, v double")
    back = sent.where("gram is not null").select("chunk", "gram").join(scored, "gram").select("chunk", "gram", F.lit(None).cast("binary").alias("token"), "v")
    back = back.unionByName(sent.where("token is not null").select("chunk", "token").join(words, "token").select("chunk", F.lit(None).cast("long").alias("gram"), "token", F.col("c").cast("double").alias("v")))
    floor = total + 0.1 * (distinct + 1)

    both = back.withColumn("kind", F.lit(0)).unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    both = both.repartitionById(min(chunks, PARTITIONS), "chunk").sortWithinPartitions("chunk", "kind")
    numbers = [("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double"), ("code_bytes", "long"), ("bits_per_byte", "double")]
    result = ", ".join(f"{c} {k}" for c, k in [("id", dict(rows.dtypes)["id"]), ("held_out", "boolean"), *numbers])
    plain = {"long": pa.int64(), "double": pa.float64()}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(iter(batches := iter(batches)), None)
        if first is not None:
            schema = pa.schema([first.schema.field("id"), ("held_out", pa.bool_()), *((c, plain[k]) for c, k in numbers)])
            yield from _chunk_scores(chain([first], batches), depth, total, floor, schema)

    return both.mapInArrow(find, result).withColumnRenamed("id", id_col)
