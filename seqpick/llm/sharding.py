"""Sharding: a uniform shuffle with exact shard sizes by a hypergeometric communication matrix.

1. Rows lie in hash blocks of id and text; only the blocks' row counts reach the driver, at most
   ``BLOCKS`` numbers.
2. The driver draws the matrix of how many rows each block sends to each shard: row by row from the
   multivariate hypergeometric law, so that rows sum to the block sizes and columns to the exact
   shard sizes. Shard sizes differ by one row at most.
3. Each block is permuted by a seeded hash, and its places are cut by its row of the matrix.
4. The places that a shard gets from all blocks are numbered without gaps, moved by a seeded affine
   permutation of the shard into cells of ``CELL`` rows, exchanged by cell, and permuted again by a
   second hash inside the cell: slots are exact, and no task holds a whole shard.

Everything follows from ids and seeds, so reruns agree whatever the partitions. Nulls: a null text
counts as empty (size 16, CRC-32 of nothing), a null id is an id like any other. Rows that repeat an
id, or have none, are told apart by their texts and spread; rows equal in both change places without a
difference. Texts of any length are only hashed. Empty table: empty result. Input columns named like a
result column are replaced.
"""

from __future__ import annotations

from decimal import Decimal
from math import exp, lgamma, log

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, without

BLOCKS, BLOCK_ROWS = 8192, 1024
CELL = 32768
#: Primes for shards of fewer rows, in longs, and of fewer than 2^61, in decimals.
STRIDE, WIDE_STRIDE = 2_147_483_647, (1 << 61) - 1
SEED = 1009
RESULT = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def matrix(blocks: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Rows that each block sends to each shard: an exact draw, as if all rows had been shuffled and dealt out."""
    rng = np.random.default_rng(seed)
    total = int(blocks.sum())
    room = np.full(shards, total // shards, np.int64)
    room[rng.permutation(shards)[: total % shards]] += 1
    out = np.zeros((len(blocks), shards), np.int64)
    for i, n in enumerate(blocks):
        left, pool = int(n), int(room.sum())
        for j in range(shards):  # one hypergeometric draw a shard: exact for any size, unlike the marginals of numpy above 10^9
            pool -= int(room[j])
            take = left if not pool else _draw(rng, int(room[j]), pool, left)
            out[i, j] = take
            left -= take
            room[j] -= take
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    if not good or not n:
        return 0
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    return _draw_large(rng, good, bad, n)


def _draw_large(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw beyond numpy's range, in a few steps whatever the numbers are.

    The law is log-concave, so its weights relative to the mode's, p, stay under min(1, exp(1 + p / 2 - p * |x|)) at
    distance x: places are proposed under that curve and accepted by the exact ratio, a product of ratios of neighbours.
    """
    lo, hi = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), lo), hi)
    choose = lambda a, b: lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)
    # a little less than p, so that rounding leaves the curve above the law
    p = min(1.0, exp(choose(good, mode) + choose(bad, n - mode) - choose(good + bad, n)) * 0.99)
    w = 1 + p / 2
    while True:
        far = rng.random() * w / p if rng.random() * (1 + w) < w else (w + rng.exponential()) / p
        x = round(far) * (1 if rng.random() < 0.5 else -1)
        if not lo <= mode + x <= hi:
            continue
        i = np.arange(1, abs(x) + 1, dtype=np.float64)
        if x > 0:
            ratio = np.log((good - mode + 1 - i) / (mode + i)) + np.log((n - mode + 1 - i) / (bad - n + mode + i))
        else:
            ratio = np.log((mode + 1 - i) / (good - mode + i)) + np.log((bad - n + mode + 1 - i) / (n - mode + i))
        if log(1 - rng.random()) + min(0.0, w - p * far) <= ratio.sum():
            return mode + x


def deal(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """``docs`` with RESULT; law is `rows`: shard counts differ by one at most."""
    docs = without(docs, RESULT)
    own = list(docs.columns)
    mark, block, cuts, place, cell, offs = (free_name(own, x) for x in ("_mark", "_block", "_cuts", "_place", "_cell", "_offs"))
    text = F.col(text_col).cast("string")
    key = F.xxhash64(F.col(id_col), text)
    rows = docs.count()
    n_blocks = int(min(BLOCKS, max(1, -(-rows // BLOCK_ROWS))))
    in_block = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(n_blocks)).cast("int")
    got = dict(docs.groupBy(in_block.alias("b")).count().collect())  # BLOCKS rows at most
    counts = np.array([got.get(i, 0) for i in range(n_blocks)], np.int64)
    m = matrix(counts, shards, seed)
    sizes = m.sum(0)
    ends, before = m.cumsum(1), m.cumsum(0) - m
    plan = docs.sparkSession.createDataFrame([(i, ends[i].tolist(), (before[i] - (ends[i] - m[i])).tolist()) for i in range(n_blocks)], f"{block} int, {cuts} array<long>, {offs} array<long>")
    docs = docs.withColumns({"size": text_size(text), "text_crc32": F.crc32(F.coalesce(text, F.lit("")).cast("binary")), mark: key, block: in_block})
    tie = [F.col(mark), F.col(id_col), F.col("size"), F.col("text_crc32")]
    first = Window.partitionBy(block).orderBy(F.xxhash64(mark, F.lit(seed + 1)), *tie)
    placed = docs.withColumn(place, F.row_number().over(first) - F.lit(1).cast("long"))
    # the plan has BLOCKS rows of ``shards`` numbers at most: 8192 * 40 * 16 bytes here
    placed = placed.join(F.broadcast(plan) if n_blocks * shards <= 1 << 20 else plan, block)
    placed = placed.withColumn("shard", F.size(F.filter(cuts, lambda e: e <= F.col(place))).cast("int"))
    of = F.array(*(F.lit(int(s)) for s in sizes))[F.col("shard")].cast("long")
    index = F.col(place) + F.col(offs)[F.col("shard")]
    # an affine permutation of the shard's places: the prime stride has no common divisor with a smaller size
    turn = F.pmod(F.xxhash64("shard", F.lit(seed + 2)), of)
    if int(sizes.max(initial=0)) < STRIDE:
        moved = F.pmod(index * F.lit(STRIDE) + turn, of)
    else:
        moved = ((index.cast("decimal(19,0)") * F.lit(Decimal(WIDE_STRIDE)) + turn) % of.cast("decimal(19,0)")).cast("long")
    placed = placed.withColumn(cell, F.floor(moved / CELL).cast("long"))
    second = Window.partitionBy("shard", cell).orderBy(F.xxhash64(mark, F.lit(seed + 3)), *tie)
    placed = placed.withColumn("slot", F.col(cell) * CELL + F.row_number().over(second) - 1)
    return placed.select(*(F.col(f"`{c}`") for c in own), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
