"""Suffix-array dedup: sparse suffix arrays over content-selected positions.

A repeated passage has ``LENGTH`` words or more that stand in two different texts. Of each window of
LENGTH - GRAM + 1 word grams the one with the least hash is retained, so two equal passages retain the
same places. Places whose gram stands only once are left out; the others travel with the words
around them (LENGTH - GRAM to the left, LENGTH to the right), sorted by gram. There the retained
suffixes are sorted, neighbours compared, and the common words of neighbours give the classes of equal
suffix prefixes of any length; the reversed left sides give the same for extensions to the left. A
window of LENGTH words is repeated where both its sides fall together in two texts; a passage is the union of such
windows over all its retained places. The occurrence with the least id is the first; others are removed.

A gram in over ``HOT_ROWS`` places doesn't come together in one task: its windows are dealt by 128 bits of
hash of all their words, counted with partial sums, and joined back, with the same result.

Exact copies are one text, searched once, and stand for passages too: of at least LENGTH words, all
but the least id's copy are removed whole. Null, empty and shorter texts: no passages. Rows with a
null id are not searched. Ids are of any type that has an order. Repeated rows give repeated rows. Repeats
inside one text are left alone. A very long text is hashed whole, alone in its slice, and sends its places in batches.
An empty table gives an empty result. Only id and text are read, so no other column clashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table, text_slices

LENGTH, GRAM = 50, 20
#: Places of one gram that are sorted together at most.
HOT_ROWS = 20_000
SLICE = 4 << 20
PIECE = 1 << 14
#: Rows of a batch that a task sends on.
SEND = 1 << 14
_BASE, _OTHER_BASE = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F


def _powers(n: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), base, np.uint64)]), dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))


def _rolling(word: np.ndarray, size: int, base: int = _BASE) -> np.ndarray:
    """A hash of each run of ``size`` words, from prefix sums modulo 2^64."""
    n = len(word)
    with np.errstate(over="ignore"):
        up = _powers(n, base)
        down = _powers(n, pow(base, -1, 1 << 64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * up, dtype=np.uint64)])
        return _mixed((total[size:] - total[: n - size + 1]) * down[: n - size + 1])


def _extreme(a: np.ndarray, size: int, best) -> np.ndarray:
    """Least or greatest of each ``size`` neighbours, by doubling."""
    out, have = a, 1
    while have < size:
        step = min(have, size - have)
        out, have = best(out[: len(out) - step], out[step:]), have + step
    return out


def minimisers(h: np.ndarray, window: int) -> np.ndarray:
    """Places of ``h`` that are the least of some ``window`` neighbours; all of equal ones."""
    if len(h) < window:
        return np.zeros(0, np.int64)
    low = _extreme(h, window, np.minimum)
    pad = np.zeros(window - 1, h.dtype)
    return np.flatnonzero(_extreme(np.concatenate([pad, low, pad]), window, np.maximum) == h)


def _word_hashes(words: list[bytes], seen: dict[bytes, int]) -> np.ndarray:
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = seen.get(w)
        if h is None:
            h = seen[w] = xxhash.xxh64_intdigest(w, 11)
        out[i] = h
    return out


def _samples(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(gram, t, pos) of every retained place, and a row (null, t, words) for each document; t: hash of the text."""
    schema = pa.schema([("gram", pa.int64()), ("t", pa.int64()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text", SLICE):
            seen: dict[bytes, int] = {}
            gs, ts, ps = [], [], []
            for t, text in zip(part.column(0).to_pylist(), texts, strict=True):
                words = (text or b"").split()
                if len(words) < length:
                    continue
                h = _rolling(_word_hashes(words, seen), gram)
                at = minimisers(h, length - gram + 1)
                gs.append(h[at].view(np.int64))
                ts.append(np.full(len(at), t))
                ps.append(at.astype(np.int32))
            if gs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (gs, ts, ps)], schema=schema)

    return docs.select("t", "text").mapInArrow(run, "gram long, t long, pos int")


def _lcp(ids: np.ndarray) -> np.ndarray:
    """Common leading ids of each row of a matrix with the row before; -1 pads and never agrees. The first row: 0."""
    same = (ids[1:] == ids[:-1]) & (ids[1:] >= 0)
    return np.r_[0, np.cumprod(same, axis=1, dtype=np.int8).sum(1, dtype=np.int64)]


def _sides(texts: list[bytes], width: int, seen: dict[bytes, int]) -> np.ndarray:
    out = np.full((len(texts), width), -1, np.int32)
    for i, t in enumerate(texts):
        w = t.split()
        out[i, : len(w)] = [seen.setdefault(x, len(seen)) for x in w]
    return out


def repeated(gram: np.ndarray, t: np.ndarray, doc: np.ndarray, pos: np.ndarray, left: list[bytes], right: list[bytes], length: int, k: int) -> tuple[np.ndarray, ...]:
    """(t, start, end, first) of runs of repeated windows. ``left`` is reversed: the nearest word first."""
    seen: dict[bytes, int] = {}
    r, lft = _sides(right, length, seen), _sides(left, length - k, seen)
    n = len(gram)

    def sorted_sides(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((*m.T[::-1], gram))
        lcp = _lcp(m[order])
        lcp[np.r_[True, gram[order][1:] != gram[order][:-1]]] = -1
        return order, lcp, (m[order] >= 0).sum(1)

    (ro, rl, rn), (lo, ll, ln) = sorted_sides(r), sorted_sides(lft)

    def classes(order: np.ndarray, lcp: np.ndarray, m: int) -> np.ndarray:
        """Which rows share their first ``m`` words: runs of neighbours that agree so far."""
        out = np.empty(n, np.int64)
        out[order] = np.cumsum(lcp < m)
        return out

    has_r, has_l = np.empty(n, np.int64), np.empty(n, np.int64)
    has_r[ro], has_l[lo] = rn, ln
    hit, first = np.zeros((length - k + 1, n), bool), np.zeros((length - k + 1, n), bool)
    for a in range(length - k + 1):
        ok = np.flatnonzero((has_l >= a) & (has_r >= length - a))
        if len(ok) < 2:
            continue
        both = classes(lo, ll, a)[ok] * (n + 2) + classes(ro, rl, length - a)[ok]
        order = np.lexsort((doc[ok], both))
        b, d, tt = both[order], doc[ok][order], t[ok][order]
        start = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        sizes = np.diff(np.r_[start, len(b)])
        many = np.repeat(np.minimum.reduceat(tt, start) != np.maximum.reduceat(tt, start), sizes)
        least = np.repeat(d[start], sizes)
        hit[a, ok[order]] = many
        first[a, ok[order]] = many & (d == least)
    out = []
    for flag in (False, True):
        m = hit & first if flag else hit & ~first
        pad = np.zeros((1, n), bool)
        edge = np.diff(np.concatenate([pad, m, pad]).astype(np.int8), axis=0)
        for row, lo_a, hi_a in _runs(edge):
            out.append((row, pos[row] - hi_a, pos[row] - lo_a + length, np.full(len(row), flag)))
    row, s, e, f = (np.concatenate(x) for x in zip(*out, strict=True))
    return t[row], doc[row], s, e, f


def _runs(edge: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Columns with their runs (first, last), from the steps between rows of a matrix of flags."""
    up, down = np.nonzero(edge.T == 1), np.nonzero(edge.T == -1)
    yield up[0], up[1], down[1] - 1


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, n_words, n_repeated, n_removed, spans, removed) of every row: words in passages that other texts
    have, those to remove, and both as arrays of [start, end) in words."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    count = F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    table = stage_table(rows.select("id", "t", count.alias("n_words")), "suffix-docs")
    firsts = table.where("id is not null").groupBy("t").agg(F.min("id").alias("doc"), F.count("*").alias("copies"))
    if dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint"):
        firsts = firsts.withColumn("ord", F.col("doc").cast("long"))
    else:  # numbers in the order of the ids
        firsts = stage_table(firsts.orderBy("doc", "t").withColumn("ord", F.monotonically_increasing_id()), "suffix-firsts")

    samples = stage_table(_samples(rows.where("id is not null"), length, gram).distinct(), "suffix-samples")
    often = samples.groupBy("gram").agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").select("gram", (F.col("n") > hot_rows).alias("hot"))
    # written first: the join below then has an exchange on either side, and a hot gram's partition can be split
    often = stage_table(often, "suffix-often")
    active = samples.join(often, "gram").groupBy("t").agg(F.collect_list(F.struct("pos", "gram", "hot")).alias("places"))
    wanted = active.join(firsts.select("t", "doc", "ord"), "t")
    found = rows.join(wanted.withColumnRenamed("doc", "id"), ["id", "t"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]

        def send() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(out, kinds, strict=True)], names=names)
            for a in out:
                a.clear()
            return batch

        for part, texts in text_slices(batches, "text", SLICE):
            for t, doc, places, text in zip(*(part.column(i).to_pylist() for i in (0, 1, 2)), texts, strict=True):
                words = (text or b"").split()
                hot = np.array([p["pos"] for p in places if p["hot"]], np.int64)
                if len(hot):
                    # the windows that hold a hot place whole, each once, as arrays
                    mark = np.zeros(len(words) - length + 2, np.int64)
                    np.add.at(mark, np.minimum(np.maximum(hot + gram - length, 0), len(mark) - 1), 1)
                    np.add.at(mark, np.minimum(hot, len(words) - length) + 1, -1)
                    starts = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                    each = _word_hashes(words, {})
                    wide, more = (_rolling(each, length, b).view(np.int64)[starts] for b in (_BASE, _OTHER_BASE))
                    for a in range(0, len(starts), SEND):
                        some = slice(a, a + SEND)
                        n = len(starts[some])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t)), pa.array(np.full(n, doc)), pa.array(wide[some]), pa.array(starts[some].astype(np.int32)), pa.nulls(n, pa.binary()), pa.array(more[some].astype(">i8").view("S8"), pa.binary()), pa.array(np.ones(n, bool))], names=names)
                for p in places:
                    if not p["hot"]:
                        at = p["pos"]
                        for a, v in zip(out, (t, doc, p["gram"], at, b" ".join(words[max(0, at - length + gram) : at][::-1]), b" ".join(words[at : at + length]), False), strict=True):
                            a.append(v)
                if len(out[0]) >= SEND:
                    yield send()
        if out[0]:
            yield send()

    names, kinds = ["t", "doc", "gram", "pos", "left", "right", "hot"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.bool_()]
    around = found.select("t", F.col("ord").alias("doc"), "places", "text").mapInArrow(cut, "t long, doc long, gram long, pos int, left binary, right binary, hot boolean")
    around = stage_table(around, "suffix-places")
    near = around.where("not hot").drop("hot").repartition("gram").sortWithinPartitions("gram")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            cols = [table.column(i) for i in range(6)]
            t, doc, g, pos = (c.to_numpy() for c in cols[:4])
            got = repeated(g, t, doc, pos.astype(np.int64), cols[4].to_pylist(), cols[5].to_pylist(), length, gram)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["t", "doc", "start", "stop", "first"])

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= PIECE:
                table = pa.Table.from_batches(held)
                g = table.column(2).to_numpy()
                end = int(np.flatnonzero(g != g[-1])[-1]) + 1 if (g != g[-1]).any() else 0
                if end:
                    yield from work(table.slice(0, end))
                    held = table.slice(end).to_batches()
        if held:
            yield from work(pa.Table.from_batches(held))

    spans = near.mapInArrow(match, "t long, doc long, start long, stop long, first boolean")
    hot = around.where("hot").select("t", "doc", "gram", F.col("right").alias("more"), F.col("pos").cast("long").alias("start")).distinct()
    classes = hot.groupBy("gram", "more").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.min("doc").alias("least")).where("a <> b").select("gram", "more", "least")
    spans = spans.unionByName(hot.join(stage_table(classes, "suffix-hot"), ["gram", "more"]).select("t", "doc", "start", (F.col("start") + length).alias("stop"), (F.col("doc") == F.col("least")).alias("first")))

    pair = F.struct("start", "stop")
    each = spans.groupBy("t").agg(F.collect_set(pair).alias("spans"), F.collect_set(F.when(~F.col("first"), pair)).alias("removed"))
    each = stage_table(firsts.select("t", "doc", "copies").join(_united(each), "t", "left"), "suffix-texts")
    out = table.join(each, "t", "left")
    copy = (F.col("copies") > 1) & (F.col("n_words") >= length) & F.col("id").isNotNull()
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop")))
    none = F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)")
    some = lambda c: F.when(F.col("id").isNull(), none).otherwise(F.coalesce(F.col(c), none))
    out = out.withColumns({"spans": F.when(copy, whole).otherwise(some("spans")), "removed": F.when(copy & (F.col("id") != F.col("doc")), whole).otherwise(some("removed"))})
    words = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return out.select(F.col("id").alias(id_col), "n_words", words("spans").alias("n_repeated"), words("removed").alias("n_removed"), "spans", "removed")


def _united(each: DataFrame) -> DataFrame:
    """(t, spans, removed) with disjoint sorted spans of the same words."""
    pair = pa.struct([("start", pa.int64()), ("stop", pa.int64())])

    def disjoint(column: pa.ListArray) -> pa.ListArray:
        flat, size = column.flatten(), np.diff(column.offsets.to_numpy())
        start, stop = (flat.field(i).to_numpy() for i in (0, 1))
        row = np.repeat(np.arange(len(column)), size)
        order = np.lexsort((start, row))
        start, stop, row = start[order], stop[order], row[order]
        # the farthest stop so far in a row: rows are set apart by more than any place
        far = int(stop.max(initial=0)) + 1
        reach = np.maximum.accumulate(stop + row * far) - row * far if len(row) else stop
        new = np.r_[True, (row[1:] != row[:-1]) | (start[1:] > reach[:-1])][: len(row)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:] - 1, len(row) - 1][: len(first)]
        at = np.r_[0, np.cumsum(np.bincount(row[first], minlength=len(column)))].astype(np.int32)
        return pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array(start[first]), pa.array(reach[last])], fields=list(pair)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), disjoint(b.column(1)), disjoint(b.column(2))], names=["t", "spans", "removed"])

    kind = "array<struct<start:bigint,stop:bigint>>"
    return each.mapInArrow(run, f"t long, spans {kind}, removed {kind}")


def strip(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the words of ``found.removed``; the white space between kept words stays as it was."""
    own = docs.columns
    word = re.compile(rb"[^\x20\x09-\x0d]+")
    joined = docs.join(found.select(id_col, F.col("removed").alias("_removed")).dropDuplicates([id_col]), id_col, "left").select(*own, "_removed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = own.index(text_col)
        for part, texts in text_slices(batches, text_col, SLICE):
            new = []
            for text, gone in zip(texts, part.column(len(own)).to_pylist(), strict=True):
                if not gone:
                    new.append(text)
                    continue
                at = [m.span() for m in word.finditer(text)]
                keep, last = [], 0
                for g in gone:
                    keep.append(text[last : at[g["start"]][0]])
                    last = at[g["stop"] - 1][1]
                new.append(b"".join([*keep, text[last:]]))
            cols = list(part.columns[: len(own)])
            cols[i] = pa.array(new, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=own)

    return joined.mapInArrow(run, docs.schema)
