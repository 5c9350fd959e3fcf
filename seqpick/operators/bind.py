"""Joins of records with side tables: identifiers to rows, rows to one value, dimensions to blanks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.text import match_key, strain_parts
from ..schema import STANDARD_RANKS, filled, free_name, rank
from ..sources.tables import table_keys

IDENTIFIERS = (("accession", "accession"), ("id", "id"), ("isolate", "isolate_id"), ("strain", "strain"))


def record_keys(df: DataFrame, on: str = "id") -> DataFrame:
    """(on, place, kind, raw, key): what a record offers for matching, in order of kinds."""
    offers = [F.struct(F.lit(i).alias("place"), F.lit(kind).alias("kind"), F.col(c).cast("string").alias("raw"), match_key(F.col(c).cast("string")).alias("key")) for i, (kind, c) in enumerate(IDENTIFIERS) if c in df.columns]
    return df.select(F.col(on).alias("_on"), F.explode(F.array(*offers)).alias("o")).select("_on", "o.*").where("key is not null")


def matched_rows(df: DataFrame, table: DataFrame, on: str = "id") -> DataFrame:
    """(_on, row_id, kind, raw): each table row that a record reaches, once, by its first identifier."""
    hits = record_keys(df, on).join(table_keys(table), "key")
    first = Window.partitionBy("_on", "row_id").orderBy("place")
    return hits.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("_on", "row_id", "place", "kind", "raw")


def bind_columns(df: DataFrame, table: DataFrame, columns: list[str], on: str = "id") -> DataFrame:
    """``df`` with a struct (value, matched_by) for each table column, named `bound_<column>`: one value, `Conflict`, or null."""
    names = {c.lower(): c for c in table.columns}
    rows = matched_rows(df, table, on).join(table.select("row_id", *(F.col(f"`{names[c.lower()]}`").alias(f"_v_{c}") for c in columns)), "row_id")
    per = []
    for c in columns:
        v = F.col(f"_v_{c}")
        kind = F.min(F.when(v.isNotNull(), F.struct("place", "row_id", "kind")))["kind"]
        value = stats.resolve(v)
        per.append(F.when(value.isNotNull(), F.struct(value.alias("value"), F.when(value == "Conflict", "conflict").otherwise(F.concat(F.lit("table:"), kind)).alias("matched_by"))).alias(f"bound_{c}"))
    got = rows.groupBy("_on").agg(*per)
    return df.join(got, df[on] == got["_on"], "left").drop("_on")


def regex_value(header: Column, pattern: str) -> Column:
    """Group `value` of a pattern, else group 1, else the whole match, without case; null if none."""
    p = re.compile(pattern)
    group = p.groupindex.get("value", 1 if p.groups else 0)
    return F.nullif(F.regexp_extract(F.coalesce(header, F.lit("")), "(?i)" + pattern.replace("(?P<", "(?<"), group), F.lit(""))


def resolve_field(df: DataFrame, field: str, table: DataFrame | None = None, regex: str | None = None, out: str = "group") -> DataFrame:
    """``df`` with a struct (value, matched_by): side table, own column, rank, header pattern, Unknown, in this order."""
    had = list(df.columns)
    options = []
    if table is not None and field.lower() in {c.lower() for c in table.columns}:
        df = bind_columns(df, table, [field])
        options.append(F.col(f"bound_{field}"))
    pair = lambda v, by: F.when(v.isNotNull(), F.struct(v.cast("string").alias("value"), F.lit(by).alias("matched_by")))
    if field in had and field != "taxonomy":
        options.append(pair(filled(F.col(field).cast("string")), "attribute"))
    if "taxonomy" in had:
        known = field in STANDARD_RANKS
        options.append(pair(rank("taxonomy", field) if known else filled(F.try_element_at(F.col("taxonomy")["lineage"], F.lit(field))), "taxonomy"))
    if regex:
        options.append(pair(regex_value(F.col("header"), regex), "header_regex"))
    options.append(pair(F.lit("Unknown"), "none"))
    return df.withColumn(out, F.coalesce(*options)).select(*had, out)


def coverage(df: DataFrame, group: str = "group", must_bind: bool = True) -> dict[str, int]:
    """How many records have their value from the table, elsewhere, in conflict or nowhere; an error if nothing bound."""
    by = F.col(group)["matched_by"]
    n = lambda c: F.count(F.when(c, 1))
    row = df.agg(n(by.startswith("table:")).alias("table"), n(by.isin("attribute", "taxonomy", "header_regex")).alias("other"), n(by == "conflict").alias("conflict"), n(by == "none").alias("unknown")).first().asDict()
    if must_bind and not row["table"] + row["other"] + row["conflict"]:
        raise ValueError("no record has a value for this field")
    return row


def known_join(df: DataFrame, side: DataFrame, on: str) -> DataFrame:
    """Left join on ``on``, where rows of ``df`` without a key are spread by their other columns instead of meeting in one task."""
    salt = free_name([*df.columns, *side.columns], "_salt")
    others = ["id"] if "id" in df.columns else [c for c, k in df.dtypes if c != on and "map<" not in k][:4]
    # no literal on either side: it would be folded, and the salt be no key
    spread = F.when(F.col(on).isNull(), F.hash(*others)).otherwise(F.hash(on)) if others else F.hash(on)
    return df.withColumn(salt, spread).join(side.withColumn(salt, F.hash(on)), [on, salt], "left").drop(salt)


def enrich(df: DataFrame, dimension: DataFrame, on: str, columns: list[str], override: bool = True) -> DataFrame:
    """Left join on ``on``: non-blank values of the dimension replace the record's, or with ``override`` off only fill blanks."""
    side = dimension.select(on, *(F.col(c).alias(f"_d_{c}") for c in columns))
    out = known_join(df, side, on)
    pick = lambda c: F.coalesce(filled(F.col(f"_d_{c}")), F.col(c)) if override else F.coalesce(filled(F.col(c)), filled(F.col(f"_d_{c}")))
    return out.withColumns({c: pick(c) for c in columns}).select(*df.columns)


def enrich_isolates(df: DataFrame, features: DataFrame) -> DataFrame:
    """Fill blank isolate and segment from source features (accession, isolate, strain, segment); the isolate name goes before the strain."""
    side = features.select("accession", F.col("isolate").alias("_i"), F.col("strain").alias("_s"), F.col("segment").alias("_g"))
    name = F.coalesce(filled(F.col("_i")), filled(F.col("_s")))
    own = filled(F.col("isolate_id"))
    source = F.when(own.isNotNull(), F.col("isolate_id_source")).when(filled(F.col("_i")).isNotNull(), "isolate").when(name.isNotNull(), "strain")
    return known_join(df, side, "accession").withColumns({"isolate_id_source": source, "isolate_id": F.coalesce(own, name), "segment": F.coalesce(filled(F.col("segment")), filled(F.col("_g")))}).select(*df.columns)


def fill_from_strain(df: DataFrame) -> DataFrame:
    """Blank host, country, date and subtype from the strain label, else the description, else the header."""
    target = F.coalesce(filled(F.col("strain")), filled(F.col("description")), F.col("header"))
    parts = strain_parts(target)
    return df.withColumns({c: F.coalesce(filled(F.col(c)), v) for c, v in parts.items()}).select(*df.columns)


def merge_labels(labels: Column, new: Column, overwrite: bool = True) -> Column:
    """Two label maps as one; where both have a key the new one wins, or with ``overwrite`` off the old one."""
    none = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(labels, none), F.coalesce(new, none)
    low, high = (a, b) if overwrite else (b, a)
    return F.map_zip_with(low, high, lambda _, x, y: F.coalesce(y, x))


#: Targets that meet every query at once.
TARGETS = 10_000


def nearest(queries: DataFrame, targets: DataFrame, distance: Column, order: str = "ord") -> DataFrame:
    """(query, target, d): the closest target of each query, the earliest of equals.

    ``queries``: query, q; ``targets``: target, ord, t; ``distance`` over q and t. Every query meets every target: in blocks
    of about TARGETS, each broadcast in its turn, keeping one row for each query by a partial aggregate.
    """
    blocks = max(1, -(-targets.count() // TARGETS))
    found = None
    for k in range(blocks):
        some = targets if blocks == 1 else targets.where(F.pmod(F.xxhash64("target"), F.lit(blocks)) == k)
        pairs = queries.crossJoin(F.broadcast(some)).withColumn("d", distance)
        best = pairs.groupBy("query").agg(F.min(F.struct("d", order, "target")).alias("b"))
        found = best if found is None else found.unionByName(best)
    if blocks > 1:
        found = found.groupBy("query").agg(F.min("b").alias("b"))
    return found.select("query", F.col("b.target").alias("target"), F.col("b.d").alias("d"))
