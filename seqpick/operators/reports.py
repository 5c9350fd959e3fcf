"""Reports as tidy tables: tallies, coverage, purity, eliminations and alarms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.text import valid_subtype
from ..schema import filled

#: Ranks at which losing a taxon is an alarm (genus and above), and the bounds of a wall of zeros.
ALARM_RANKS = ("genus", "subfamily", "family", "suborder", "order", "subclass", "class")
WALL_SHARE, WALL_LEAST = 0.6, 3
TIDY = ["report", "rank", "pool", "taxon", "taxon_count", "spec", "metric", "value"]


def melt(df: DataFrame, ranks: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """(keep…, rank, taxon): one row for each record and rank that has a label."""
    pairs = F.array(*(F.struct(F.lit(r).alias("rank"), filled(c).alias("taxon")) for r, c in ranks.items()))
    return df.select(*(keep or []), F.explode(pairs).alias("x")).select(*(keep or []), "x.rank", "x.taxon").where("taxon is not null")


def tally(df: DataFrame, ranks: dict[str, Column]) -> DataFrame:
    """(rank, taxon, n): every rank counted by itself in one pass; blanks are no taxon."""
    return melt(df, ranks).groupBy("rank", "taxon").agg(F.count("*").alias("n"))


def distinct_taxa(counts: DataFrame) -> DataFrame:
    """(rank, n_taxa, n) over a tally."""
    return counts.groupBy("rank").agg(F.count("*").alias("n_taxa"), F.sum("n").alias("n"))


def eliminated(before: DataFrame, after: DataFrame, ranks: tuple[str, ...] = ALARM_RANKS) -> DataFrame:
    """Taxa of the tally ``before`` that ``after`` has none of, at the alarm ranks."""
    return before.where(F.col("rank").isin(*ranks)).join(after, ["rank", "taxon"], "left_anti")


def top_or_eliminated(before: DataFrame, after: DataFrame, k: int = 20, ranks: tuple[str, ...] = ALARM_RANKS) -> DataFrame:
    """The top ``k`` taxa of each rank, and however far down every eliminated one at an alarm rank."""
    both = before.join(after.select("rank", "taxon", F.col("n").alias("n_after")), ["rank", "taxon"], "left").withColumn("n_after", F.coalesce("n_after", F.lit(0).cast("bigint")))
    place = F.row_number().over(Window.partitionBy("rank").orderBy(F.desc("n"), "taxon"))
    gone = (F.col("n_after") == 0) & F.col("rank").isin(*ranks)
    return both.withColumn("place", place).withColumn("gone", gone).where((F.col("place") <= k) | F.col("gone"))


def purity(df: DataFrame, cluster: str, value: Column, length: Column | None = None) -> DataFrame:
    """(cluster, size, purity, n_distinct[, length min, max, median]): the majority's share of the filled values."""
    rows = df.select(F.col(cluster).alias("cluster"), filled(value.cast("string")).alias("v"), *([length.alias("len")] if length is not None else []))
    counts = rows.where("v is not null").groupBy("cluster", "v").agg(F.count("*").alias("c")).groupBy("cluster").agg((F.max("c") / F.sum("c")).alias("purity"), F.count("*").alias("n_distinct"))
    more = [F.min("len").alias("min_length"), F.max("len").alias("max_length"), F.bround(F.median("len")).cast("bigint").alias("median_length")] if length is not None else []
    return rows.groupBy("cluster").agg(F.count("*").alias("size"), *more).join(counts, "cluster", "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0).cast("bigint")))


def coverage(df: DataFrame, taxon: Column, specs: dict[str, Column]) -> DataFrame:
    """(taxon, spec, n, covered): records of each taxon, and those with each spec."""
    pairs = F.array(*(F.struct(F.lit(s).alias("spec"), F.coalesce(c, F.lit(False)).alias("has")) for s, c in specs.items()))
    return df.select(taxon.alias("taxon"), F.explode(pairs).alias("x")).groupBy("taxon", "x.spec").agg(F.count("*").alias("n"), F.count(F.when(F.col("x.has"), 1)).alias("covered"))


def length_pivot(df: DataFrame, taxon: str, segment: str, isolate: str, length: Column, segments: list[str]) -> DataFrame:
    """One row for each taxon: the mean length of each segment, and of whole isolates as `total`."""
    rows = df.select(F.col(taxon).alias("taxon"), F.col(segment).alias("segment"), F.col(isolate).alias("isolate"), length.alias("len"))
    wide = rows.groupBy("taxon").pivot("segment", segments).agg(F.avg("len"))
    whole = rows.groupBy("taxon", "isolate").agg(F.sum("len").alias("len")).groupBy("taxon").agg(F.avg("len").alias("total"))
    return wide.join(whole, "taxon")


def length_summary(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """min, max, median, iqr (exclusive quartiles) and n of each group."""
    return df.groupBy(*group).agg(*stats.quartiles(value))


def walls(df: DataFrame, taxon: str, spec: str, has: Column) -> DataFrame:
    """(taxon, home, peptides, covered, zeros, n, alarm): the spec a taxon is at home in, and how much of it is missing.

    ``df``: one row for each record, spec and peptide. Home: most covered, then most peptides, then the first name.
    """
    per = df.groupBy(F.col(taxon).alias("taxon"), F.col(spec).alias("spec"), "peptide").agg(F.count(F.when(has, 1)).alias("c"), F.count("*").alias("n"))
    specs = per.groupBy("taxon", "spec").agg(F.count("*").alias("peptides"), F.count(F.when(F.col("c") > 0, 1)).alias("covered"), F.max("n").alias("n"))
    home = specs.withColumn("p", F.row_number().over(Window.partitionBy("taxon").orderBy(F.desc("covered"), F.desc("peptides"), "spec"))).where("p = 1").drop("p")
    zeros = F.col("peptides") - F.col("covered")
    alarm = (F.col("n") >= WALL_LEAST) & ((F.col("covered") == 0) | (zeros / F.col("peptides") >= WALL_SHARE))
    return home.select("taxon", F.col("spec").alias("home"), "peptides", "covered", zeros.alias("zeros"), "n", alarm.alias("alarm"))


def subtype_shares(before: DataFrame, after: DataFrame, column: str = "subtype") -> DataFrame:
    """(subtype, n_before, n_after, share): null is the unassigned."""
    count = lambda d, n: d.groupBy(valid_subtype(F.col(column)).alias("subtype")).agg(F.count("*").alias(n))
    a, b = count(before, "n_before"), count(after, "n_after").withColumnRenamed("subtype", "_s")
    both = a.join(b, F.expr("subtype <=> _s"), "full_outer")
    total = F.sum("n_after").over(Window.partitionBy())
    out = both.select(F.coalesce("subtype", "_s").alias("subtype"), F.coalesce("n_before", F.lit(0).cast("bigint")).alias("n_before"), F.coalesce("n_after", F.lit(0).cast("bigint")).alias("n_after"))
    return out.withColumn("share", F.when(total > 0, F.col("n_after") / total))


def label_table(pre: DataFrame, pool: DataFrame, reps: DataFrame, column: str) -> DataFrame:
    """(value, n_pre, n_pool, n_reps, n_pre_shown): a value's count before cleaning, in the pool and among representatives.

    The first is withheld throughout if any value has more in the pool than before: then the units differ.
    """
    part = lambda d, n: d.groupBy(F.col(column).alias("value")).agg(F.count("*").alias(n)).where("value is not null")
    out = part(pre, "n_pre").join(part(pool, "n_pool"), "value", "full_outer").join(part(reps, "n_reps"), "value", "full_outer").fillna(0)
    bad = F.max((F.col("n_pool") > F.col("n_pre")).cast("int")).over(Window.partitionBy()) == 1
    return out.withColumn("n_pre_shown", F.when(~bad, F.col("n_pre")))


def lost_labels(pre: DataFrame, log: DataFrame, column: str) -> DataFrame:
    """Values all of whose records are in the removal log, with the commonest kind of reason (the first of equals)."""
    rows = pre.select("id", F.col(column).alias("value")).where("value is not null").join(log.select("id", "stage").distinct(), "id", "left")
    per = rows.groupBy("value", "stage").agg(F.countDistinct("id").alias("c"))
    whole = rows.groupBy("value").agg(F.countDistinct("id").alias("n"), F.countDistinct(F.when(F.col("stage").isNotNull(), F.col("id"))).alias("gone")).where("n = gone")
    first = Window.partitionBy("value").orderBy(F.desc("c"), "stage")
    return per.where("stage is not null").withColumn("p", F.row_number().over(first)).where("p = 1").join(whole, "value").select("value", "n", "stage")


def profile(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, filled, n, share): how far each field is filled, all in one pass."""
    n = df.agg(F.count("*").alias("n"), *(F.count(filled(F.col(f).cast("string"))).alias(f) for f in fields))
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("filled")) for f in fields))
    return n.select("n", F.explode(pairs).alias("x")).select("x.field", "x.filled", "n", F.when(F.col("n") > 0, F.col("x.filled") / F.col("n")).alias("share"))


def tidy(report: str, df: DataFrame, metrics: list[str], rank: str | None = None, pool: str | None = None, taxon: str | None = None, count: str | None = None, spec: str | None = None) -> DataFrame:
    """Wide to the fixed long form, a row for each metric that has a value."""
    text = lambda c: (F.col(c) if c else F.lit(None)).cast("string")
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
    rows = df.select(F.lit(report).alias("report"), text(rank).alias("rank"), text(pool).alias("pool"), text(taxon).alias("taxon"), (F.col(count) if count else F.lit(None)).cast("bigint").alias("taxon_count"), text(spec).alias("spec"), F.explode(pairs).alias("x"))
    return rows.select(*TIDY[:-2], "x.metric", "x.value").where("value is not null")


def segment_status(rows: DataFrame) -> DataFrame:
    """(rank, taxon, n_trees, n_broken, broken, single_break) of monophyly rows (rank, taxon, tree, status)."""
    bad = F.col("status") != "monophyletic"
    return rows.groupBy("rank", "taxon").agg(F.count("*").alias("n_trees"), F.count(F.when(bad, 1)).alias("n_broken"), F.array_join(F.array_sort(F.collect_set(F.when(bad, F.col("tree")))), ",").alias("broken")).withColumn("single_break", F.col("n_broken") == 1)


def alarms(**parts: DataFrame) -> DataFrame:
    """(alarm, subject, detail): the union of alarm queries; each part brings subject and detail."""
    return reduce(DataFrame.unionByName, [d.select(F.lit(name).alias("alarm"), F.col("subject").cast("string"), F.col("detail").cast("string")) for name, d in parts.items()])


def text_table(df: DataFrame, order: list[Column | str], numbers: tuple[str, ...] = ("tinyint", "smallint", "int", "bigint", "float", "double")) -> DataFrame:
    """(place, value): a table as lines of text, a heading and a rule before them; names to the left, numbers to the right.

    Cells are as wide as the widest of their column; nulls are a dash.
    """
    kinds = dict(df.dtypes)
    cell = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\s+", " "), F.lit("-"))
    cells = df.orderBy(*order).select(F.monotonically_increasing_id().alias("place"), *(cell(c).alias(c) for c in df.columns))
    widths = df.agg(*(F.greatest(F.coalesce(F.max(F.length(cell(c))), F.lit(0)), F.lit(len(c))).alias(c) for c in df.columns)).first()
    pad = lambda c, v: (F.lpad if kinds[c] in numbers else F.rpad)(v, widths[c], " ")
    line = lambda get: F.rtrim(F.concat_ws("  ", *(pad(c, get(c)) for c in df.columns)))
    head = df.sparkSession.range(1).select(F.explode(F.array(F.struct(F.lit(-2).cast("long").alias("place"), line(lambda c: F.lit(c)).alias("value")), F.struct(F.lit(-1).cast("long").alias("place"), F.lit("  ".join("-" * widths[c] for c in df.columns)).alias("value")))).alias("x")).select("x.*")
    return head.unionByName(cells.select("place", line(F.col).alias("value"))).orderBy("place")


def proteins_long(df: DataFrame, carry: list[str]) -> DataFrame:
    """One row for each protein; records without any vanish."""
    return df.select(*carry, F.posexplode("proteins").alias("nth", "p")).select(*carry, "nth", "p.*")


def hit_cell(hits: Column) -> Column:
    """Passing hits as `Name(E=,cov=)` joined by semicolons."""
    cov = lambda h: F.least(F.lit(1.0), F.greatest(F.lit(0), h["hmm_to"] - h["hmm_from"] + 1) / F.greatest(F.lit(1), h["hmm_len"]))
    return F.array_join(F.transform(F.filter(hits, lambda h: h["passing"]), lambda h: F.format_string("%s(E=%.1e,cov=%.2f)", h["target"], h["dom_evalue"], cov(h))), ";")


def hit_grid(reps: DataFrame, profiles: list[str], hits: DataFrame) -> DataFrame:
    """(id, target, dom_evalue): every representative by every profile, with its best hit or null."""
    grid = reps.select("id", F.explode(F.array(*map(F.lit, profiles))).alias("target"))
    best = hits.groupBy("id", "target").agg(F.min("dom_evalue").alias("dom_evalue"))
    return grid.join(best, ["id", "target"], "left")
