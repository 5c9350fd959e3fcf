"""Records with several parts: naming parts, completeness, collisions and assembly."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_id
from ..schema import filled
from .bind import regex_value
from .qc import Stage, protect_flag


def isolate_of(df: DataFrame, pattern: str | None) -> DataFrame:
    """Fill `isolate_id` from the header where it is null, and note that source."""
    got = F.col("isolate_id")
    if pattern:
        group = "isolate" in re.compile(pattern).groupindex
        found = regex_value(F.col("header"), pattern.replace("(?P<isolate>", "(?P<value>") if group else pattern)
        source = F.coalesce("isolate_id_source", F.when(got.isNull() & found.isNotNull(), "regex"))
        df = df.withColumn("isolate_id_source", source).withColumn("isolate_id", F.coalesce(got, found))
    return df


def segment_of(segment: Column, header: Column, names: list[str], pattern: str | None = None, aliases: dict[str, list[str]] | None = None) -> Column:
    """The configured name of a part: the own field as name, number or alias; a header pattern; the longest name or alias
    of two letters or more in the header; `segment N` in the header."""
    exact = {n.lower(): n for n in names}
    alias = exact | {a.lower(): n for n, many in (aliases or {}).items() for a in many if a}

    def choose(pairs: dict[str, str], c: Column) -> Column:
        out = F.lit(None).cast("string")
        for k, v in pairs.items():
            out = F.when(F.lower(c) == k, F.lit(v)).otherwise(out)
        return out

    by_number = lambda c: F.when(c.rlike("^[0-9]{1,6}$"), F.get(F.array(*map(F.lit, names)), c.try_cast("int") - 1))
    own = filled(segment)
    steps = [F.when(own.isNotNull(), F.coalesce(choose(exact, own), by_number(own), choose(alias, own), own))]
    if pattern:
        got = regex_value(header, pattern.replace("(?P<segment>", "(?P<value>"))
        steps.append(F.when(got.isNotNull(), F.coalesce(choose(exact, got), by_number(got), choose(alias, got), got)))
    for term in sorted((t for t in alias if len(t) >= 2), key=lambda t: -len(t)):
        steps.append(F.when(header.rlike(r"(?i)\b" + re.escape(term).replace(r"\ ", " ") + r"\b"), F.lit(alias[term])))
    steps.append(by_number(F.regexp_extract(F.coalesce(header, F.lit("")), r"(?i)\bsegment\s+(\d+)\b", 1)))
    return F.coalesce(*steps)


def best_parts(df: DataFrame, key: str = "isolate_key") -> DataFrame:
    """One record for each (isolate, part): the longest, the first seen of equals."""
    w = Window.partitionBy(key, "segment").orderBy(F.length("sequence").desc(), "input_ord")
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def strain_collisions(df: DataFrame) -> DataFrame:
    """(isolate_id, segment, accessions): names taken from the strain under which a part has several accessions."""
    acc = F.coalesce("accession", "id")
    rows = df.where((F.col("isolate_id_source") == "strain") & filled(F.col("isolate_id")).isNotNull() & filled(F.col("segment")).isNotNull())
    return rows.groupBy("isolate_id", "segment").agg(F.array_sort(F.collect_set(acc)).alias("accessions")).where(F.size("accessions") > 1)


def drop_collisions(df: DataFrame) -> Stage:
    """All records of a colliding (isolate, part) go."""
    bad = strain_collisions(df).select("isolate_id", "segment")
    gone = df.join(bad, ["isolate_id", "segment"], "left_semi")
    log = gone.select("id", F.lit("strain_collision").alias("stage"), F.concat(F.lit("strain_collision:"), F.col("segment")).alias("reason"))
    return Stage(df.join(bad, ["isolate_id", "segment"], "left_anti").select(*df.columns), log, log.limit(0))


def complete(df: DataFrame, virus: dict, extra: str = "warn") -> tuple[Stage, DataFrame]:
    """(the parts of isolates that have all expected ones, (isolate, extras)): one record a part, in configured order.

    ``virus``: segments, isolate_regex, segment_regex, segment_aliases. ``extra`` drop: isolates with other parts go.
    """
    names = virus["segments"]
    named = isolate_of(df, virus.get("isolate_regex"))
    named = named.withColumn("segment", segment_of(F.col("segment"), F.col("header"), names, virus.get("segment_regex"), virus.get("segment_aliases")))
    named = named.withColumn("isolate_key", norm_id(F.col("isolate_id")))
    known = best_parts(named.where("isolate_key is not null and segment is not null"))
    expected = F.array(*map(F.lit, names))
    w = Window.partitionBy("isolate_key")
    have = F.collect_set("segment").over(w)
    known = known.withColumn("_missing", F.array_sort(F.array_except(expected, have))).withColumn("_extra", F.array_sort(F.array_except(have, expected)))
    reason = F.when(F.size("_missing") > 0, F.concat(F.lit("incomplete_isolate:missing_segments:"), F.array_join("_missing", ",")))
    if extra == "drop":
        reason = F.when(F.size("_extra") > 0, F.concat(F.lit("extra_segments:"), F.array_join("_extra", ","))).otherwise(reason)
    known = known.withColumn("_reason", reason)
    log = known.where("_reason is not null").select("id", F.lit("completeness").alias("stage"), F.col("_reason").alias("reason"))
    lost = named.where("isolate_key is null or segment is null").select("id", F.lit("completeness").alias("stage"), F.lit("segmented_filter:could_not_identify_isolate_or_segment").alias("reason"))
    kept = known.where("_reason is null").where(F.array_contains(expected, F.col("segment"))).withColumn("segment_ord", F.array_position(expected, F.col("segment")))
    extras = known.where(F.size("_extra") > 0).select("isolate_key", F.col("_extra").alias("extras")).distinct()
    return Stage(kept.drop("_missing", "_extra", "_reason"), log.unionByName(lost), log.limit(0)), extras


def part_lengths(df: DataFrame, bounds: dict[str, tuple[int | None, int | None]], protect: DataFrame | None = None) -> Stage:
    """An isolate with a part outside its bounds goes; the first such part in order names the reason."""
    n = F.length("sequence")
    bad = F.lit(None).cast("string")
    for segment, (lo, hi) in bounds.items():
        low = n < lo if lo is not None else F.lit(False)
        high = n > hi if hi is not None else F.lit(False)
        bad = F.when((F.col("segment") == segment) & (low | high), F.concat(F.lit(f"segment_length:{segment}:"), n.cast("string"))).otherwise(bad)
    rows = protect_flag(df, protect, "length").withColumn("_bad", bad)
    w = Window.partitionBy("isolate_key")
    rows = rows.withColumn("_reason", F.min(F.when(F.col("_bad").isNotNull(), F.struct("segment_ord", "_bad"))).over(w)["_bad"])
    log = lambda d: d.select("id", F.lit("segment_length").alias("stage"), F.col("_reason").alias("reason"))
    return Stage(rows.where("_reason is null or _protected").select(*df.columns), log(rows.where("_reason is not null and not _protected")), log(rows.where("_reason is not null and _protected")))


def complete_among(df: DataFrame, names: list[str], failed: DataFrame) -> int:
    """How many isolates of ``failed`` (isolate_key) have all expected parts in ``df``."""
    have = df.join(failed.select("isolate_key").distinct(), "isolate_key", "left_semi").where(F.col("segment").isin(*names)).groupBy("isolate_key").agg(F.countDistinct("segment").alias("n"))
    return have.where(F.col("n") == len(set(names))).count()


def assemble(df: DataFrame, carry: tuple[str, ...] = ("organism", "host", "country", "collection_date", "strain", "subtype")) -> DataFrame:
    """One row for each isolate: bodies, marker proteins and proteins joined in order of parts, flags that hold for all, the first
    filled metadata. Proteins are null where no part has been looked up, and an empty list where there are none."""
    more = [c for c in ("protein_sequence", "proteins", "taxonomy") if c in df.columns]
    slim = [F.col("taxonomy").getField("taxid").alias("taxid") if c == "taxonomy" else F.col(c) for c in more]
    part = F.struct("segment_ord", "input_ord", "segment", "accession", "id", "sequence", *slim, *(F.col(c) for c in carry if c in df.columns))
    sums = [F.bool_and(F.coalesce(c, F.lit(False))).alias(c) for c in ("is_refseq", "is_reviewed")]
    if "taxonomy" in more:  # a map inside keeps it from being sorted: the first part's, by its place
        sums.append(F.min_by("taxonomy", F.when(F.col("taxonomy").isNotNull(), F.struct("segment_ord", "input_ord"))).alias("taxonomy"))
    rows = df.groupBy("isolate_key").agg(F.array_sort(F.collect_list(part)).alias("p"), *sums, F.min("input_ord").alias("input_ord"))
    first = lambda c: F.get(F.filter(F.transform("p", lambda x: filled(x[c])), lambda x: x.isNotNull()), F.lit(0))
    each = lambda c: F.filter(F.transform("p", lambda x: x[c]), lambda x: x.isNotNull())
    extra = []
    if "protein_sequence" in more:
        extra.append(F.nullif(F.array_join(each("protein_sequence"), ""), F.lit("")).alias("protein_sequence"))
    if "proteins" in more:
        extra.append(F.when(F.size(each("proteins")) > 0, F.flatten(each("proteins"))).alias("proteins"))
    if "taxonomy" in more:
        extra.append(F.col("taxonomy"))
    return rows.select(
        F.concat(F.lit("CONCAT|"), F.col("isolate_key")).alias("id"), F.col("isolate_key").alias("isolate_id"), F.array_join(F.transform("p", lambda x: x["sequence"]), "").alias("sequence"),
        F.transform("p", lambda x: F.struct(x["segment"].alias("segment"), x["accession"].alias("accession"), x["id"].alias("id"), F.length(x["sequence"]).alias("length"))).alias("concat_segments"),
        "is_refseq", "is_reviewed", "input_ord", *extra, *(first(c).alias(c) for c in carry if c in df.columns),
    )
