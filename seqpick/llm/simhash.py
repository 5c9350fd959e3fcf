"""SimHash near-duplicates, linked through a hierarchical index in Gray order.

``fingerprints``: one Arrow pass over whole texts. ``links``: only distinct fingerprints are
compared. Two that differ in at most r of 64 bits agree on at least two of r + 2 equal blocks, so
each is dealt once for every pair of blocks by the bits of those two: that shared masked pattern is
the top node of an index. Below it the codes are sorted by Gray rank, neighbours form leaves, and
each upper node holds the bits that all codes under it share; a search adds up the differences on
its way down and leaves a whole group as soon as they exceed r. Every run of codes with the same
pattern is a tree of its own, however small, and many trees are searched at once. A fingerprint has at most 2,080
others within two bits, and a node sends only the edges of a star for each connected part, so no
group sends all its pairs. ``components`` joins the stars across partitions by alternating star
contraction; each round is written to the shared folder.

Nodes are fingerprints (near duplicates: sets of shingles), not ids, so ids may be of any type, repeat
or be null: a component is named by the least id in it, null if it has none. Null and empty texts have
no shingles: fingerprint zero, linked like any other. Texts are hashed in slices of bytes, a very long one
alone. An empty table gives an empty result. Columns other than id and text are not read, so none clashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, drop_table, free_name, stage_table, text_slices, without

SEED = 42
SLICE = 4 << 20
#: Codes of a leaf of the index, nodes under an upper one, and codes that are searched for at a time.
LEAF, FAN, QUERIES = 4, 4, 2048
#: Codes of a run that one task holds.
RUN_ROWS = 1 << 20


def shingle_hashes(text: bytes | None, words: int) -> list[int]:
    """XXH64 of each shingle of ``words`` words, repeats included; fewer words: of the whole sequence; none: nothing."""
    w = (text or b"").translate(LOWER).split()
    if not w:
        return []
    if len(w) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(w), SEED)]
    line = b" ".join(w)
    sizes = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    h = xxhash.xxh64_intdigest
    return [h(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=False)]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of ``sizes`` hashes the bits that are set in over half of them (0 for an empty run)."""
    out = np.zeros(len(sizes), np.uint64)
    if not len(hashes):
        return out
    # runs are cut into pieces of at most 255, so that eight one-byte counters in a word can't overflow
    pieces = -(-sizes // 255)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = np.repeat(np.cumsum(sizes) - sizes, pieces) + 255 * nth
    full = np.flatnonzero(sizes)
    first = np.searchsorted(owner, full)
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & np.uint64(0x0101010101010101), cuts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            out[full] |= (counts[:, byte] * 2 > sizes[full]).astype(np.uint64) << np.uint64(8 * byte + shift)
    return out


def fingerprints(docs: DataFrame, out: str = "fp", words: int = 3, text_col: str = "text") -> DataFrame:
    """``docs`` with the 64-bit fingerprint of the whole text as a signed long in column ``out``."""
    docs = without(docs, [out])
    whole = free_name(docs.columns, "_text")
    schema = T.StructType([*docs.schema, T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, whole, SLICE):
            each = [shingle_hashes(t, words) for t in texts]
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            flat = np.fromiter((h for x in each for h in x), np.uint64, int(sizes.sum()))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(majority(flat, sizes).view(np.int64))], names=schema.names)

    return docs.withColumn(whole, F.col(text_col).cast("string")).mapInArrow(run, schema)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _masks(radius: int) -> list[int]:
    """Masks of two of radius + 2 blocks, as signed longs."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [x - (1 << 64) if x >> 63 else x for x in (a | b for a, b in combinations(block, 2))]


def gray_rank(code: Column) -> Column:
    """The place of a 64-bit code in reflected Gray order, as a long that sorts like the unsigned rank."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def _pieces(starts: np.ndarray, total: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups of ``total`` items, cut into pieces of ``size``: where the pieces start, and where the groups start among them."""
    many = -(-np.diff(np.r_[starts, total]) // size)
    first = np.cumsum(many) - many
    return np.repeat(starts - first * size, many) + np.arange(many.sum()) * size, first


class GrayIndex:
    """Codes (rows of 64-bit words) in Gray order under nodes of shared bits: a tree for each run of codes.

    Level 0: leaves of LEAF codes; each level above joins FAN nodes, until each run has one.
    """

    def __init__(self, codes: np.ndarray, starts: np.ndarray):
        self.codes = codes
        self.run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(codes)]))
        self.levels = []  # of each node: its bits, which of them are shared, its first child and how many, its last code
        every = some = codes
        ends = np.arange(len(codes))
        size = LEAF
        while True:
            total = len(every)
            cuts, starts = _pieces(starts, total, size)
            every, some = np.bitwise_and.reduceat(every, cuts), np.bitwise_or.reduceat(some, cuts)
            ends = ends[np.r_[cuts[1:], total] - 1]
            self.levels.append((every, ~(every ^ some), cuts, np.diff(np.r_[cuts, total]), ends))
            if len(starts) == len(cuts):
                return
            size = FAN

    def near(self, a: int, b: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j), as indexes, of codes a to b - 1 with later ones of their run that differ in at most ``radius`` bits."""
        codes = self.codes
        q = np.arange(a, b)
        node, gone, seen = self.run[a:b], np.zeros(b - a, np.int64), np.zeros_like(codes[a:b])
        last = None
        for value, shared, first, many, end in reversed(self.levels):
            gone = gone + np.bitwise_count((codes[q] ^ value[node]) & shared[node] & ~seen).sum(1, dtype=np.int64)
            keep = (gone <= radius) & (q < end[node])
            q, node, gone = q[keep], node[keep], gone[keep]
            seen, n = shared[node], many[node]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            last = np.repeat(first[node], n) + at
            q, gone, seen, node = np.repeat(q, n), np.repeat(gone, n), np.repeat(seen, n, axis=0), last
        keep = q < node
        q, node = q[keep], node[keep]
        keep = np.bitwise_count(codes[q] ^ codes[node]).sum(1, dtype=np.int64) <= radius
        return q[keep], node[keep]


def _contract(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give both ends of each edge the lesser label, until nothing changes; labels are indexes of their own parts."""
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def run_stars(codes: np.ndarray, nodes: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its part) within each run of equal ``run``; codes (rows of words) in Gray order inside a run."""
    n = len(codes)
    label = np.arange(n)
    if n:
        index = GrayIndex(codes, np.flatnonzero(np.r_[True, run[1:] != run[:-1]]))
        for at in range(0, n, QUERIES):
            _contract(label, *index.near(at, min(at + QUERIES, n), radius))
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, label, nodes)
    root = least[label]
    far = root != nodes
    return nodes[far], root[far]


def links(classes: DataFrame, radius: int = 2, run_rows: int = RUN_ROWS) -> DataFrame:
    """(a, b): star edges that connect the same nodes as all links of fingerprints at most ``radius`` bits apart.

    ``classes`` has one row for each distinct fingerprint: fp long, node long. A run of over ``run_rows`` codes is
    searched in pairs of blocks.
    """
    masks = _masks(radius)
    dealt = classes.select("fp", "node", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("pair", "bits"))
    dealt = dealt.select(F.col("pair").cast("long").alias("pair"), "bits", "node", F.col("fp").alias("c0"))
    return _stars(_in_blocks(dealt, run_rows, len(masks)), 1, radius)


def _stars(dealt: DataFrame, width: int, radius: int) -> DataFrame:
    """(a, b): star edges of the parts within every run of equal (pair, bits). ``dealt``: pair, bits, node, c0, c1 …; all longs."""
    dealt = dealt.repartition("pair", "bits").sortWithinPartitions("pair", "bits", gray_rank(F.col("c0")))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []  # the rows of the run that the last batch ended in

        def stars(p: np.ndarray) -> pa.RecordBatch:
            change = np.r_[True, (p[0, 1:] != p[0, :-1]) | (p[1, 1:] != p[1, :-1])]
            run = np.cumsum(change)
            many = np.bincount(run)[run] > 1
            codes = np.ascontiguousarray(p[3:, many].T).view(np.uint64)
            a, b = run_stars(codes, p[2, many], run[many], radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            p = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3 + width)])
            last = np.flatnonzero((p[0] != p[0, -1]) | (p[1] != p[1, -1]))
            cut = last[-1] + 1 if len(last) else 0
            same = kept and kept[-1][0, -1] == p[0, 0] and kept[-1][1, -1] == p[1, 0]
            if kept and not same:
                yield stars(np.concatenate(kept, axis=1))
                kept = []
            if cut:
                yield stars(np.concatenate([*kept, p[:, :cut]], axis=1))
                kept = []
            kept.append(p[:, cut:])
        if kept:
            yield stars(np.concatenate(kept, axis=1))

    return dealt.mapInArrow(search, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that is connected, for every node of ``edges`` (a, b) but the least ones."""
    edges = stage_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    mark = None
    before = edges
    while True:
        # large star: each node's greater neighbours go to the least of its neighbourhood
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its lesser neighbours go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = stage_table(small.distinct(), "edges")
        drop_table(before)
        before = edges
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = now


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp long, component) of every row of ``docs``."""
    rows = stage_table(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "fp", words).select("id", "fp"), "fingerprints")
    classes = stage_table(rows.groupBy("fp").agg(F.min("id").alias("id")), "classes")
    parts = components(links(classes.select("fp", F.col("fp").alias("node")), radius))
    named = classes.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("component", "fp").alias("part"))
    least = named.groupBy("part").agg(F.min("id").alias("component"))
    # a written table, not an aggregate that lies dealt out by fp already: so the join has two exchanges, and a hot fingerprint's can be split
    named = stage_table(named.join(least, "part").select("fp", "component"), "named")
    return rows.join(named, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less all but one row of each component: the one with the least id, null last. ``groups``: of ``near_groups``.

    Rows are told apart by id and text, so one id may have texts in several components; of rows that are equal in both one stays.
    """
    a, b, nth = (free_name(docs.columns, x) for x in ("_k1", "_k2", "_nth"))
    stay = groups.where("first").select(F.col("k1").alias(a), F.col("k2").alias(b))
    left = docs.withColumns(dict(zip((a, b), row_keys(id_col, text_col), strict=True))).join(stay, [a, b], "left_semi")
    order = Window.partitionBy(a, b).orderBy(*(F.col(f"`{c}`") for c, k in docs.dtypes if "map<" not in k and k != "variant"))
    return left.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))


def row_keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """128 bits that tell rows of different ids or texts apart."""
    ident, text = F.col(id_col), F.col(text_col).cast("string")
    return F.xxhash64(ident, text), F.xxhash64(text, ident, F.lit(SEED))


#: Near duplicates by similarity: bins of a sketch, words of a wide fingerprint, rows of a bin's shingle that come together.
BINS, WIDE, HOT_RUN = 8, 4, 20_000
#: Code pairs that meet in the index at a time, and shingles that are compared.
PAIRS, SHINGLES = 1 << 19, 1 << 20


@cache
def _bit_differs(similarity: float, most: int = 32) -> float:
    """The greatest probability that a bit differs in two sets with this share of common shingles.

    Large sets have the cosine 2s / (1 + s) at least, and a bit differs with probability angle / pi. Small ones differ
    more, as even sets can tie: those of up to ``most`` shingles are counted out.
    """
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    for b in range(1, most + 1):
        for a in range(max(1, ceil(similarity * b - 1e-9)), b + 1):
            both = ceil(similarity * (a + b) / (1 + similarity) - 1e-9)
            if both > a:
                continue
            ways = 0
            for s in range(both + 1):
                up_a = sum(comb(a - both, x) for x in range(a - both + 1) if 2 * (s + x) > a)
                up_b = sum(comb(b - both, x) for x in range(b - both + 1) if 2 * (s + x) > b)
                ways += comb(both, s) * (up_a * (2 ** (b - both) - up_b) + up_b * (2 ** (a - both) - up_a))
            p = max(p, ways / 2 ** (a + b - both))
    return p


def wide_radius(similarity: float, bits: int = 64 * WIDE, slack: float = 5) -> int:
    """Bits that two texts with this share of common shingles differ in at most, but for ``slack`` standard deviations: a filter, not a verdict."""
    p = _bit_differs(similarity)
    return int(np.ceil(bits * p + slack * np.sqrt(bits * p * (1 - p))))


def _remix(h: np.ndarray, k: int) -> np.ndarray:
    """Further hashes of a hash."""
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def distinct_shingles(text: bytes | None, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def _mark(shingles: np.ndarray) -> int:
    """The identity of a set of shingles, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def sketches(docs: DataFrame, words: int = 5, bins: int = BINS, width: int = WIDE) -> DataFrame:
    """``docs`` (text last) with mark long, size long, code array<long>, keys array<long> in place of the text: of its set of distinct shingles.

    Mark: its identity; code: a fingerprint of ``width`` words; keys: the least hash of each bin (null: empty bin).
    """
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([*docs.schema[:-1], *(T.StructField(c, k) for c, k in (("mark", T.LongType()), ("size", T.LongType()), ("code", longs), ("keys", longs)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text", SLICE):
            each = [distinct_shingles(t, words) for t in texts]
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            flat = np.concatenate(each)
            codes = np.stack([majority(_remix(flat, k) if k else flat, sizes) for k in range(width)], 1).view(np.int64)
            least = np.full((len(each), bins), np.iinfo(np.uint64).max, np.uint64)
            full = np.flatnonzero(sizes)
            if len(full):
                order, starts = _remix(flat, width), (np.cumsum(sizes) - sizes)[full]
                for b in range(bins):
                    least[full, b] = np.minimum.reduceat(np.where(order % np.uint64(bins) == b, order, np.iinfo(np.uint64).max), starts)
            none = (least == np.iinfo(np.uint64).max).ravel()
            at = np.arange(len(each) + 1)
            lists = [pa.ListArray.from_arrays((at * k).astype(np.int32), v) for k, v in ((width, pa.array(codes.ravel())), (bins, pa.array(least.view(np.int64).ravel(), mask=none)))]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([_mark(x) for x in each], pa.int64()), pa.array(sizes), *lists], names=schema.names)

    return docs.mapInArrow(run, schema)


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal values in the first two columns (longs)."""
    kept: list[pa.RecordBatch] = []  # the rows of the run that the last batch ended in
    for batch in batches:
        if not batch.num_rows:
            continue
        pair, bits = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        last = np.flatnonzero((pair != pair[-1]) | (bits != bits[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if kept and (kept[-1].column(0)[-1].as_py() != pair[0] or kept[-1].column(1)[-1].as_py() != bits[0]):
            yield pa.Table.from_batches(kept)
            kept = []
        if cut:
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)])
            kept = []
        kept.append(batch.slice(cut))
    if kept:
        yield pa.Table.from_batches(kept)


def _columns(table: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in names])


def _run_numbers(pair: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return np.cumsum(np.r_[True, (pair[1:] != pair[:-1]) | (bits[1:] != bits[:-1])])


def gray_order(codes: np.ndarray, run: np.ndarray) -> np.ndarray:
    """The order that sorts codes (rows of words, the first the highest) by their place in reflected Gray order inside each run; runs are in order."""
    ranks, odd = [], np.zeros(len(codes), np.uint64)
    for w in codes.T:
        w = w.copy()
        for shift in (1, 2, 4, 8, 16, 32):
            w ^= w >> np.uint64(shift)
        w ^= odd  # all bits turn if those before are odd in number
        odd = np.uint64(0) - (w & np.uint64(1))
        ranks.append(w)
    return np.lexsort((*reversed(ranks), run))


def run_pairs(codes: np.ndarray, sizes: np.ndarray, run: np.ndarray, radius: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j), as indexes, of each run whose codes differ in at most ``radius`` bits and whose sizes allow the similarity: all found through the index."""
    if not len(codes):
        return
    order = gray_order(codes, run)
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    index = GrayIndex(codes[order], starts)
    many = np.diff(np.r_[starts, len(codes)])
    met = np.cumsum(np.repeat(many, many))  # codes that the codes up to each one may meet
    at = 0
    while at < len(codes):
        end = max(at + 1, int(np.searchsorted(met, (met[at - 1] if at else 0) + PAIRS, "right")))
        i, j = (order[x] for x in index.near(at, end, radius))
        i, j = np.minimum(i, j), np.maximum(i, j)
        keep = np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j]) - 1e-9
        yield i[keep], j[keep]
        at = end


def _candidates(dealt: DataFrame, radius: int, similarity: float) -> DataFrame:
    """The rows of ``dealt`` that have a candidate in their run: (pair, bits, node, size, c0 …). A pair of texts counts in the first bin it shares."""
    codes, keys = [f"c{i}" for i in range(WIDE)], [f"k{i}" for i in range(BINS)]
    out = ["pair", "bits", "node", "size", *codes]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_runs(batches):
            p = _columns(table, [*out, *keys])
            run = _run_numbers(p[0], p[1])
            p = p[:, np.bincount(run)[run] > 1]
            if not p.shape[1]:
                continue
            run, key, first = _run_numbers(p[0], p[1]), p[len(out) :], p[0] % BINS
            found = np.zeros(p.shape[1], bool)
            for i, j in run_pairs(np.ascontiguousarray(p[4 : len(out)].T).view(np.uint64), p[3], run, radius, similarity):
                left = ~(found[i] & found[j])
                i, j = i[left], j[left]
                fresh = np.ones(len(i), bool)
                for b in range(BINS - 1):
                    fresh &= ~((b < first[i]) & (key[b, i] == key[b, j]) & (key[b, i] != -1))
                found[i[fresh]] = found[j[fresh]] = True
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in p[: len(out), found]], names=out)

    return _by_runs(dealt.select(*out, *keys)).mapInArrow(search, ", ".join(f"{c} long" for c in out))


def _by_runs(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("pair", "bits").sortWithinPartitions("pair", "bits", "node")


def _alike(i: int, others: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Which of ``others`` have Jaccard similarity of ``similarity`` or more with set ``i``, by their shingles."""
    mine = flat[starts[i] : starts[i] + sizes[i]]
    out = np.zeros(len(others), bool)
    ends = np.cumsum(sizes[others])
    at = 0
    while at < len(others):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SHINGLES, "right")))
        some = others[at:end]
        theirs = np.concatenate([flat[starts[j] : starts[j] + sizes[j]] for j in some])
        place = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
        both = np.add.reduceat((mine[place] == theirs).astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
        out[at:end] = both >= similarity * (sizes[i] + sizes[some] - both) - 1e-9
        at = end
    return out


def _exact_stars(found: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(a, b): star edges of the parts within every run that are linked by exact Jaccard similarity. ``found``: rows of ``_candidates`` with their set."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    codes = [f"c{i}" for i in range(WIDE)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_runs(batches):
            p = _columns(table, ["pair", "bits", "node", "size", *codes])
            nodes, sizes, n = p[2], p[3], p.shape[1]
            flat = table.column("shingles").combine_chunks().flatten().to_numpy().view(np.uint64)
            starts, label = np.cumsum(sizes) - sizes, np.arange(n)
            for i, j in run_pairs(np.ascontiguousarray(p[4:].T).view(np.uint64), sizes, _run_numbers(p[0], p[1]), radius, similarity):
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
                order = np.argsort(i, kind="stable")
                i, j = i[order], j[order]
                cuts = np.flatnonzero(np.r_[True, i[1:] != i[:-1], True]) if len(i) else []
                for x, y in zip(cuts, cuts[1:], strict=False):
                    others = j[x:y][label[j[x:y]] != label[i[x]]]
                    if len(others):
                        others = others[_alike(int(i[x]), others, flat, starts, sizes, similarity)]
                        _contract(label, np.full(len(others), i[x]), others)
            least = np.full(n, np.iinfo(np.int64).max)
            np.minimum.at(least, label, nodes)
            root = least[label]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[root != nodes]), pa.array(root[root != nodes])], schema=schema)

    return _by_runs(found).mapInArrow(search, "a long, b long").distinct()


def _shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, shingles array<long>) of ``docs`` (text), sorted as unsigned."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_slices(batches, "text", SLICE):
            each = [distinct_shingles(t, words) for t in texts]
            at = np.cumsum([0, *map(len, each)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([_mark(x) for x in each], pa.int64()), pa.ListArray.from_arrays(at, pa.array(np.concatenate(each).view(np.int64)))], schema=schema)

    return docs.select("text").mapInArrow(run, "node long, shingles array<long>")


def _in_blocks(base: DataFrame, hot_run: int, step: int) -> DataFrame:
    """``base`` with the runs of over ``hot_run`` rows cut into blocks of about half as many, each two of which are a run of their own.

    So every two rows of a hot run still meet, in tasks of bounded rows. Runs are named pair + step * (number of the pair of blocks).
    """
    hot = base.groupBy("pair", "bits").agg(F.count("*").alias("n")).where(F.col("n") > hot_run)
    hot = hot.select("pair", "bits", F.ceil(F.col("n") * 2 / hot_run).cast("long").alias("blocks"))
    if hot.isEmpty():
        return base
    hot = stage_table(hot, "hot")
    cold = base.join(hot, ["pair", "bits"], "left_anti")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    cut = base.join(hot, ["pair", "bits"]).withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    two = F.least("_mine", "_other") * F.col("blocks") + F.greatest("_mine", "_other") + 1
    return cold.unionByName(cut.withColumn("pair", F.col("pair") + step * two).select(*cold.columns))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, hot_run: int = HOT_RUN) -> DataFrame:
    """(id, component, k1, k2, first): groups of texts that links of exact Jaccard similarity ``similarity`` or more over distinct shingles connect.

    k1, k2: ``row_keys``; first: of its component the row with the least id, null last. The nodes are distinct sets of
    shingles. Two meet where the least shingle of one of BINS bins is the same (at 0.8 they miss all with
    probability 0.2^8), and are candidates if their 256-bit fingerprints and sizes allow the similarity (``wide_radius``: five standard
    deviations): in each bin's run they are found through the index, in Gray order. Only sets with a candidate are sent to their bins whole, and only pairs that are not connected yet are compared there,
    shingle by shingle; so no group sends all its pairs. A bin's shingle that over ``hot_run`` sets share (a line that many texts have) is searched
    in pairs of blocks: all against all, whatever else they share.
    """
    radius = wide_radius(similarity)
    k1, k2 = row_keys(id_col, text_col)
    texts = docs.select(F.col(id_col).alias("id"), k1.alias("k1"), k2.alias("k2"), F.col(text_col).cast("string").alias("text"))
    rows = stage_table(sketches(texts, words), "sketches")
    # nulls last: false sorts before true
    row = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("row")
    classes = stage_table(rows.groupBy("mark").agg(row, F.max("size").alias("size"), F.max("code").alias("code"), F.max("keys").alias("keys")), "classes")
    code = [F.col("code")[i].alias(f"c{i}") for i in range(WIDE)]
    keys = [F.coalesce(F.col("keys")[i], F.lit(-1)).alias(f"k{i}") for i in range(BINS)]
    base = classes.select(F.col("mark").alias("node"), "size", *code, *keys, F.posexplode("keys").alias("pair", "bits")).where("bits is not null").withColumn("pair", F.col("pair").cast("long"))
    found = stage_table(_candidates(_in_blocks(base, hot_run, BINS), radius, similarity), "candidates")
    wanted = found.select("node").distinct().join(classes.select(F.col("mark").alias("node"), "row.k1", "row.k2"), "node")
    source = texts.join(wanted.select("k1", "k2"), ["k1", "k2"], "left_semi")
    sets = _shingle_sets(source, words).groupBy("node").agg(F.first("shingles").alias("shingles"))
    parts = stage_table(components(_exact_stars(found.join(sets, "node").select(*found.columns, "shingles"), radius, similarity)), "parts")
    named = stage_table(classes.select("mark", "row").join(parts, F.col("mark") == F.col("node"), "left").select("mark", "row", F.coalesce("component", "mark").alias("part")), "named")
    least = named.groupBy("part").agg(F.min("row").alias("least"))
    named = stage_table(named.join(least, "part").select("mark", "least"), "named")
    first = (F.col("k1") == F.col("least.k1")) & (F.col("k2") == F.col("least.k2"))
    return rows.select("id", "k1", "k2", "mark").join(named, "mark").select("id", F.col("least.id").alias("component"), "k1", "k2", first.alias("first"))
