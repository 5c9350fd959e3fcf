"""Filters that explain themselves, and keep-best duplicates.

Each stage takes records and returns ``Stage``: the rows it keeps, a log (id, stage, reason) of those it
removes, and a log of those it would have removed but a protect list holds. Counters are aggregates of the logs.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import free_name

#: Stages that a protect list may name, in order.
STAGES = ("duplicates", "length", "ambiguous", "annotation", "protein_count", "taxonomy_consistency", "protein_quality", "hmm", "marker_quality")


class Stage(NamedTuple):
    kept: DataFrame
    removed: DataFrame
    protected: DataFrame


def isolate_or_row() -> Column:
    """The isolate as a key to join by; records without one spread by their own id, which no isolate has."""
    return F.coalesce(F.col("isolate_id").cast("string"), F.concat(F.lit("\0"), F.col("id").cast("string")))


def join_isolates(df: DataFrame, facts: DataFrame) -> DataFrame:
    """``df`` with the columns of ``facts`` (isolate_id, …; one row each) by isolate, null elsewhere."""
    key = free_name([*df.columns, *facts.columns], "_isolate")
    return df.withColumn(key, isolate_or_row()).join(facts.withColumn(key, F.col("isolate_id").cast("string")).drop("isolate_id"), key, "left").drop(key)


def protect_flag(df: DataFrame, protect: DataFrame | None, stage: str, stages: tuple[str, ...] = STAGES, name: str = "_protected") -> DataFrame:
    """``df`` with ``name``: an identifier is on the list (`id`), or its isolate has such a record."""
    if protect is None or stage not in stages:
        return df.withColumn(name, F.lit(False))
    key, hit = (free_name([*df.columns, name], x) for x in ("_key", "_hit"))
    keys = protect.select(X.match_key(F.col("id")).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn(hit, F.lit(True))
    names = [c for c in ("accession", "id", "isolate_id") if c in df.columns]
    out = df.withColumn(name, F.lit(False))
    for n in names:  # keys are distinct, so no row is doubled
        out = out.withColumn(key, X.match_key(F.col(n))).join(keys, key, "left").withColumn(name, F.col(name) | F.col(hit).isNotNull()).drop(key, hit)
    if "isolate_id" in names:
        whole = out.where(F.col(name) & F.col("isolate_id").isNotNull()).select("isolate_id").distinct().withColumn(hit, F.lit(True))
        out = join_isolates(out, whole).withColumn(name, F.col(name) | F.col(hit).isNotNull()).drop(hit)
    return out


def gate(df: DataFrame, stage: str, reason: Column, protect: DataFrame | None = None) -> Stage:
    """Removes the rows whose ``reason`` is not null."""
    held, why = free_name(df.columns, "_protected"), free_name(df.columns, "_reason")
    flagged = protect_flag(df.withColumn(why, reason), protect, stage, name=held)
    log = lambda rows: rows.select("id", F.lit(stage).alias("stage"), F.col(why).alias("reason"))
    kept = flagged.where(F.col(why).isNull() | F.col(held)).select(*df.columns)
    return Stage(kept, log(flagged.where(F.col(why).isNotNull() & ~F.col(held))), log(flagged.where(F.col(why).isNotNull() & F.col(held))))


def best_copy(df: DataFrame, name: str, body: str = "sequence", best: tuple[str, ...] = ("is_refseq", "is_reviewed"), order: str = "input_ord") -> DataFrame:
    """``df`` with ``name``: the id of the best record with its body, where that is another record.

    Flags in order, then the first seen. A null body is nobody's copy. Copies are counted by digest and length with
    partial sums; only digests that occur twice come back, so a body of many copies never lies in one task.
    """
    digest, n, top = (free_name([*df.columns, name], x) for x in ("_digest", "_n", "_top"))
    text = F.col(body)
    keyed = df.withColumn(digest, F.concat_ws(":", F.md5(text), F.length(text).cast("string")))
    # a record without a body has its own key
    keyed = keyed.withColumn(digest, F.when(text.isNull(), F.concat(F.lit("null:"), F.col("id").cast("string"))).otherwise(F.col(digest)))
    rank = F.struct(*(F.when(F.col(b), 0).when(~F.col(b), 1).otherwise(2).alias(f"f{i}") for i, b in enumerate(best)), F.col(order).alias("ord"), F.col("id").alias("id"))
    tops = keyed.where(text.isNotNull()).groupBy(digest).agg(F.min(rank).alias(top), F.count("*").alias(n)).where(F.col(n) > 1).drop(n)
    other = ~(F.col(top)["id"].eqNullSafe(F.col("id")) & F.col(top)["ord"].eqNullSafe(F.col(order)))
    return keyed.join(tops, digest, "left").withColumn(name, F.when(F.col(top).isNotNull() & other, F.col(top)["id"].cast("string"))).select(*df.columns, name)


def exact_duplicates(df: DataFrame, protect: DataFrame | None = None, body: str = "sequence", best: tuple[str, ...] = ("is_refseq", "is_reviewed"), order: str = "input_ord") -> Stage:
    """Of equal bodies the best stays: flags in order, then the first seen. Reason `exact_duplicate_of:<id>`."""
    name = free_name(df.columns, "_best")
    out = gate(best_copy(df, name, body, best, order), "duplicates", F.concat(F.lit("exact_duplicate_of:"), F.col(name)), protect)
    return Stage(out.kept.drop(name), out.removed, out.protected)


def length_reason(n: Column, lo: int | None, hi: int | None) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    if lo is not None:
        out = out.when(n < lo, F.concat(F.lit("length_too_short:"), n.cast("string")))
    return out.when(n > hi, F.concat(F.lit("length_too_long:"), n.cast("string"))) if hi is not None else out


def length_bounds(df: DataFrame, lo: int | None, hi: int | None, protect: DataFrame | None = None, body: str = "sequence") -> Stage:
    return gate(df, "length", length_reason(F.length(body), lo, hi), protect)


def ambiguity_gate(df: DataFrame, most: float = 0.05, protect: DataFrame | None = None) -> Stage:
    share = X.ambiguity(F.col("sequence"), F.col("seq_type"))
    return gate(df, "ambiguous", F.when(share > most, F.format_string("ambiguous_chars:%.4f", share)), protect)


def annotation_gate(df: DataFrame, keywords: tuple[str, ...] = X.KEYWORDS, protect: DataFrame | None = None) -> Stage:
    hit = X.keyword_hit(F.col("description"), F.col("header"), keywords)
    return gate(df, "annotation", F.when(hit.isNotNull(), F.concat(F.lit("annotation_keyword:"), hit)), protect)


def protein_count(df: DataFrame, least: int = 1, expected: dict[str, list[int]] | None = None, protect: DataFrame | None = None) -> Stage:
    """Null proteins pass (not fetched); fewer than ``least``, or not an expected number for the segment, fail."""
    n = F.size("proteins")
    reason = F.when(F.col("proteins").isNull(), None).when(n < least, F.concat(F.lit("too_few_proteins:"), n.cast("string")))
    for segment, allowed in (expected or {}).items():
        reason = reason.when((F.col("segment") == segment) & ~n.isin(*allowed), F.concat(F.lit("unexpected_protein_count:"), n.cast("string")))
    return gate(df, "protein_count", reason, protect)


def protein_quality(df: DataFrame, most: float = 0.05, protect: DataFrame | None = None, segmented: bool = False) -> Stage:
    """The worst share of X, B, Z and J over the proteins; none translated counts as 1. Segmented: one bad record removes the isolate."""
    worst = F.array_max(F.transform("proteins", lambda p: F.when(F.coalesce(F.length(p["sequence"]), F.lit(0)) == 0, 1.0).otherwise(X.ambiguity(p["sequence"], "protein"))))
    bad = F.when(F.col("proteins").isNotNull() & (worst > most), worst)
    reason = F.when(bad.isNotNull(), F.format_string("bad_protein:%.4f", bad))
    if segmented:
        name = free_name(df.columns, "_sibling")
        failed = df.where(bad.isNotNull() & F.col("isolate_id").isNotNull()).select("isolate_id").distinct().withColumn(name, F.lit("bad_protein_sibling"))
        got = gate(join_isolates(df, failed), "protein_quality", F.coalesce(reason, F.col(name)), protect)
        return Stage(got.kept.drop(name), got.removed, got.protected)
    return gate(df, "protein_quality", reason, protect)


def taxonomy_consistency(df: DataFrame, label: Column, protect: DataFrame | None = None) -> Stage:
    """An isolate with two labels or more (case and blanks aside) is removed; records without isolate pass."""
    norm = F.nullif(F.regexp_replace(F.lower(F.trim(label)), r"\s+", " "), F.lit(""))
    name = free_name(df.columns, "_mixed")
    mixed = df.where(F.col("isolate_id").isNotNull()).groupBy("isolate_id").agg((F.min(norm) != F.max(norm)).alias(name)).where(name)
    got = gate(join_isolates(df, mixed), "taxonomy_consistency", F.when(F.col(name), F.lit("inconsistent_taxonomy")), protect)
    return Stage(got.kept.drop(name), got.removed, got.protected)


def blocklist(df: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records whose accession and id aren't listed, audit (id, action)): listed ids are `excluded` or `unavailable`."""
    keys = ids.select(F.col("id").alias("listed"), X.match_key(F.col("id")).alias("_key")).where("_key is not null").distinct()
    long = df.select(F.explode(F.array_distinct(F.filter(F.array(X.match_key(F.col("accession")), X.match_key(F.col("id"))), lambda x: x.isNotNull()))).alias("_key")).distinct()
    found = keys.join(long, "_key", "left_semi").select(F.col("listed").alias("id"), F.lit("excluded").alias("action"))
    lost = keys.join(long, "_key", "left_anti").select(F.col("listed").alias("id"), F.lit("unavailable").alias("action"))
    only = keys.select("_key").distinct()
    kept = df
    for name in ("accession", "id"):
        kept = kept.withColumn("_match", X.match_key(F.col(name))).join(only.withColumnRenamed("_key", "_match"), "_match", "left_anti").select(*df.columns)
    return kept, found.unionByName(lost)


def run_basic(df: DataFrame, cfg: dict, protect: DataFrame | None = None) -> Stage:
    """Duplicates, length, ambiguity, annotation in this order, in one pass.

    Only the first looks at other rows, and it looks at all of them; so every stage's reason is a column, a row falls at its
    first reason that isn't protected, and is told as protected at those before.
    """
    reasons: list[tuple[str, Column]] = []
    copy, held, fell_at = (free_name(df.columns, x) for x in ("_best", "_protected", "_f"))
    if cfg.get("remove_duplicates", True):
        df2 = best_copy(df, copy)
        reasons.append(("duplicates", F.concat(F.lit("exact_duplicate_of:"), F.col(copy))))
    else:
        df2 = df
    lo, hi = cfg.get("min_length"), cfg.get("max_length")
    if lo is not None or hi is not None:
        reasons.append(("length", length_reason(F.length("sequence"), lo, hi)))
    share = X.ambiguity(F.col("sequence"), F.col("seq_type"))
    reasons.append(("ambiguous", F.when(share > cfg.get("ambiguous_threshold", 0.05), F.format_string("ambiguous_chars:%.4f", share))))
    if cfg.get("annotation_filter", True):
        hit = X.keyword_hit(F.col("description"), F.col("header"), tuple(cfg.get("keywords", X.KEYWORDS)))
        reasons.append(("annotation", F.when(hit.isNotNull(), F.concat(F.lit("annotation_keyword:"), hit))))
    rows = protect_flag(df2, protect, "duplicates", name=held)
    # a protected row falls nowhere and is told at every stage; another falls at its first reason, and no later one is evaluated
    first = F.coalesce(*(F.when(r.isNotNull(), F.struct(F.lit(stage).alias("stage"), r.alias("reason"))) for stage, r in reasons))
    fell = rows.where(~F.col(held)).withColumn(fell_at, first)
    every = F.array_compact(F.array(*(F.when(r.isNotNull(), F.struct(F.lit(stage).alias("stage"), r.alias("reason"))) for stage, r in reasons)))
    told = lambda df: df.select("id", F.col(fell_at)["stage"].alias("stage"), F.col(fell_at)["reason"].alias("reason"))
    removed = told(fell.where(F.col(fell_at).isNotNull()))
    if protect is None:
        return Stage(fell.where(F.col(fell_at).isNull()).select(*df.columns), removed, removed.limit(0))
    kept = rows.withColumn(fell_at, F.when(~F.col(held), first)).where(F.col(fell_at).isNull()).select(*df.columns)
    return Stage(kept, removed, told(rows.where(F.col(held)).select("id", F.explode(every).alias(fell_at))))


def counters(log: DataFrame) -> DataFrame:
    """(stage, reason, n): a log by stage and kind of reason."""
    return log.groupBy("stage", X.short_reason(F.col("reason")).alias("reason")).agg(F.count("*").alias("n"))


def running_survivors(total: int, counts: DataFrame, order: list[str]) -> DataFrame:
    """(stage, removed, survivors): what is left after each stage of ``order``."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("stage"))
    per = counts.groupBy("stage").agg(F.sum("n").alias("removed")).withColumn("place", place)
    return per.select("stage", "removed", (F.lit(total) - F.sum("removed").over(Window.orderBy("place"))).alias("survivors"))
