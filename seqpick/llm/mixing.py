"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

Sizes are words. A source's target is its share of all words by weight, at most ``MAX_EPOCHS`` times
its own size; the excess goes to the others by weight until none is above. Targets become integer
quotas of equal blocks of ``BLOCK`` words: the highest quotients target / (2k + 1) win, first between
sources, then between the hash shards of a source by their words. In a shard the documents lie end
to end in seeded order on a line cut into blocks; the quota is taken in whole rounds over the line
and for the rest by a seeded choice of blocks: every stretch of ``STRETCH`` blocks gets its share of the
rest, and in it the blocks with the least keyed hash are chosen. So a document is taken in every
round and for its part of the chosen blocks, never above ``MAX_EPOCHS`` times.

Null and empty texts have size 0 and are taken 0 times. A null source is a source, the last in
order. Shards are dealt by id and text, so rows that repeat an id, or have none, spread; only rows that are
equal in both lie in one shard, and each is taken in its own place. Ties between quotients go to the first
source or shard. Very long texts are counted by one regular expression and lie on many blocks. All
rows stay in the result, also where all sizes are 0; an empty table gives an empty result.
``mix`` returns the id and RESULT alone, ``repeat`` the input's own columns, whatever their names.
The list of sources passes one task: a row of four numbers for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage_table

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
BLOCK = 32
SEED = 271
#: Rows of a (source, shard) group that the table is dealt into, and the most shards a source has.
SHARD_ROWS, SHARDS = 1024, 2048
STRETCH = 16
RESULT = ["size", "source_size", "target", "taken"]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: weight by its place in order, and target. ``sizes``: source, source_size; a row for each source.

    Sources are capped in order of cap / weight: one is capped if the level that the rest would
    reach without it lies above its cap. That is where resharing the excess again and again ends.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("place", F.row_number().over(order)).withColumn("weight", F.array(*map(F.lit, weights))[(F.col("place") - 1) % len(weights)])
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    every, before = Window.partitionBy(), by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "left": F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "weights": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    rows = rows.withColumns({"nth": F.row_number().over(by_ratio), "even": F.col("left") / F.col("weights")})
    # the first row in order that isn't capped has the level of all after it
    rows = rows.withColumn("level", F.min(F.when(F.col("cap") / F.col("weight") >= F.col("even"), F.struct("nth", "even"))).over(every)["even"])
    return rows.withColumn("target", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap")))).select("source", "place", "source_size", "weight", "target")


def apportion(rows: DataFrame, group: list[str], order: list[str], share: str, seats: str, cap: str, out: str) -> DataFrame:
    """Sainte-Lague: ``seats`` of each group to its rows by highest quotients ``share`` / (2k + 1), at most ``cap`` a row.

    A row has round(share / divisor) seats for some common divisor. The divisor is found by halving;
    seats that are left between its last two values go to the highest next quotients, in ``order``.
    The bounds on the number of rows of a group are SHARDS and the number of sources.
    """
    wanted = F.array_agg(F.struct(F.col(share).alias("s"), F.col(cap).alias("c"))).alias("all")
    base = rows.groupBy(*group).agg(wanted, F.max(seats).alias("n"), F.sum(share).alias("sum"))

    def given(divisor: Column) -> Column:
        return F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + F.least(x["c"], F.floor(x["s"] / divisor + 0.5).cast("long")))

    def halve(a: Column, _: Column) -> Column:
        mid = F.sqrt(a["lo"] * a["hi"])
        return F.transform(F.array(mid), lambda m: F.when(given(m) > F.col("n"), F.struct(m.alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), m.alias("hi"))))[0]

    # divisor 2 * sum gives nobody more than one seat in two; a tiny one fills all caps
    start = F.struct((F.col("sum") / (F.col("n") + 1) / 1e6).alias("lo"), (F.col("sum") * 2 + 1).alias("hi"))
    base = base.withColumn("d", F.when((F.col("n") > 0) & (F.col("sum") > 0), F.aggregate(F.sequence(F.lit(1), F.lit(80)), start, halve)["hi"]))
    got = rows.join(base.select(*[F.col(g).alias(f"_{g}") for g in group], "d"), F.expr(" AND ".join(f"{g} <=> _{g}" for g in group))).drop(*[f"_{g}" for g in group])
    got = got.withColumn("k", F.coalesce(F.least(F.col(cap), F.floor(F.col(share) / F.col("d") + 0.5).cast("long")), F.lit(0).cast("long")))
    whole = Window.partitionBy(*group)
    nth = F.row_number().over(whole.orderBy((F.col("k") < F.col(cap)).desc(), (F.col(share) / (F.col("k") * 2 + 1)).desc(), *order))
    extra = (nth <= F.col(seats) - F.sum("k").over(whole)) & (F.col("k") < F.col(cap)) & (F.col(share) > 0)
    return got.withColumn(out, F.col("k") + F.when(extra, 1).otherwise(0)).drop("k", "d")


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> list[Column]:
    text = F.col(text_col).cast("string")
    return [F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"), F.xxhash64(F.col(id_col), text).alias("key")]


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row (id, RESULT, source) for each document."""
    got = mix_sizes(stage_table(docs.select(*_sized(docs, id_col, source_col, text_col)), "sizes"), weights, max_epochs, block, seed)
    return got.select(F.col("id").alias(id_col), *RESULT, "source")


def mix_sizes(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``sized`` (id, source, size, key, and what else is to come along; it is read three times) with RESULT."""
    n = min(SHARDS, max(1, -(-sized.count() // SHARD_ROWS)))
    rows = sized.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(n)).cast("int"))
    blocks = F.ceil(F.col("words") / block).cast("long")
    shards = rows.groupBy("source", "shard").agg(F.sum("size").alias("words")).withColumn("blocks", blocks)
    sources = shards.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("blocks").alias("blocks"))
    goal = targets(sources, weights, max_epochs)
    goal = goal.join(sources.select(F.col("source").alias("s2"), "blocks"), F.expr("source <=> s2")).drop("s2")
    goal = goal.withColumns({"one": F.least("place", F.lit(1)), "cap": F.col("blocks") * max_epochs, "share": F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)})
    # in blocks as they are: the last one of each line is short, so a block holds source_size / blocks words on the mean
    goal = goal.withColumn("seats", F.round(F.sum("share").over(Window.partitionBy())).cast("long"))
    quota = apportion(goal, ["one"], ["place"], "share", "seats", "cap", "quota")
    # a source at its cap is taken whole, all rounds; the last block of a line may be short
    quota = quota.withColumn("quota", F.when(F.col("target") >= F.col("source_size") * max_epochs, F.col("cap")).otherwise(F.col("quota")))
    parts = shards.join(quota.select(F.col("source").alias("s2"), "source_size", "target", "quota"), F.expr("source <=> s2")).drop("s2")
    parts = parts.withColumns({"cap": F.col("blocks") * max_epochs, "share": F.col("blocks").cast("double")})
    parts = apportion(parts, ["source"], ["shard"], "share", "quota", "cap", "part")
    rounds = F.when(F.col("blocks") > 0, F.floor(F.col("part") / F.col("blocks"))).otherwise(0).cast("long")
    # the quotas are written: the plan below reads them once for every row's shard
    parts = stage_table(parts.select(F.col("source").alias("s2"), F.col("shard").alias("h2"), "source_size", "target", "blocks", rounds.alias("rounds"), (F.col("part") - rounds * F.col("blocks")).alias("rest")), "quotas")
    line = Window.partitionBy("source", "shard").orderBy(F.xxhash64("key", F.lit(seed + 1)), "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = rows.withColumn("stop", F.sum("size").over(line)).withColumn("start", F.col("stop") - F.col("size"))
    laid = laid.join(parts, F.expr("source <=> s2 AND shard = h2"))
    turn = F.pmod(F.xxhash64("source", "shard", F.lit(seed + 2)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    given = lambda b: F.floor(F.least(b, F.col("blocks")) * F.col("rest") / F.col("blocks") + turn)  # noqa: E731  the rest that the blocks before b have
    hashed = lambda b: F.xxhash64("source", "shard", b, F.lit(seed + 4))

    def chosen(b: Column) -> Column:
        first = F.floor(b / STRETCH) * STRETCH
        least = F.filter(F.sequence(first, F.least(first + STRETCH, F.col("blocks")) - 1), lambda c: hashed(c) < hashed(b))
        return F.size(least) < given(first + STRETCH) - given(first)

    overlap = lambda b: F.least(F.col("stop"), (b + 1) * block) - F.greatest(F.col("start"), b * block)
    touched = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))
    some = F.when((F.col("size") > 0) & (F.col("rest") > 0), F.aggregate(touched, F.lit(0).cast("long"), lambda a, b: a + F.when(chosen(b), overlap(b)).otherwise(0))).otherwise(0)
    taken = (F.col("rounds") * F.col("size") + some).cast("long")
    return laid.select(*sized.columns, F.col("source_size").cast("long").alias("source_size"), "target", taken.alias("taken"))


def repeat(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix as rows: ``docs`` (a written table) in whole copies, taken / size of each row, rounded up or down by a seeded hash.

    On the whole a source keeps its taken words. Each row carries its own number, whatever ids repeat or are null.
    """
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("row")
    got = mix_sizes(docs.select(*_sized(docs, id_col, source_col, text_col), row), weights, max_epochs, block, seed)
    spin = F.pmod(F.xxhash64("key", F.lit(seed + 3)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    times = F.floor(F.col("taken") / F.col("size") + spin).cast("int")
    many = got.where("taken > 0").withColumn("times", times).where("times > 0").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return many.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))
