"""Readers of side tables and of other tools' outputs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import match_key

#: Columns that say which record a row is about, in any case.
KEY_COLUMNS = ("accession", "id", "isolate", "isolate_id", "strain", "seqname")


def sniff_delimiter(header: str, path: str = "") -> str:
    """The most frequent of tab, semicolon and comma; without any, by the file's name."""
    best = max("\t;,", key=header.count)
    if header.count(best):
        return best
    return "\t" if re.search(r"\.(tsv|txt)$", path, re.I) else ","


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A metadata table: all strings, cells trimmed, blanks null, with `row_id` in file order.

    It needs a key column and a row, else ValueError.
    """
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError(f"metadata table is empty: {path}")
    df = spark.read.option("header", True).option("sep", sniff_delimiter(first[0][0], path)).option("multiLine", True).csv(path)
    names = [c.lstrip("﻿").strip() for c in df.columns]
    df = df.toDF(*names)
    if not any(n.lower() in KEY_COLUMNS for n in names):
        raise ValueError(f"metadata table has no key column ({', '.join(KEY_COLUMNS)}): {', '.join(names)}")
    df = df.select(*(F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")).alias(n) for n in names)).withColumn("row_id", F.monotonically_increasing_id())
    if not df.take(1):
        raise ValueError(f"metadata table has a header but no rows: {path}")
    return df


def table_keys(table: DataFrame) -> DataFrame:
    """(key, row_id) for each identifier that a row can be reached by."""
    parts: list[Column] = []
    for c in table.columns:
        if c.lower() in KEY_COLUMNS:
            cell = F.col(f"`{c}`")
            if c.lower() == "seqname":
                word = F.regexp_extract(F.trim(cell), r"^(\S+)", 1)
                parts += [match_key(word), match_key(F.substring_index(word, "|", 1))]
            else:
                parts.append(match_key(cell))
    return table.select("row_id", F.explode(F.array_distinct(F.array(*parts))).alias("key")).where("key is not null")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id a line; blank lines and comments are skipped."""
    value = F.trim("value")
    return spark.read.text(path).select(value.alias("id")).where((F.col("id") != "") & ~F.col("id").startswith("#"))


def union_ids(spark: SparkSession, inline: list[str] | None = None, paths: list[str] | None = None) -> DataFrame:
    """Ids given in the configuration and in files, each once."""
    out = spark.createDataFrame([(x.strip(),) for x in inline or [] if x.strip()], "id string")
    for p in paths or []:
        out = out.unionByName(read_ids(spark, p))
    return out.distinct()


def read_cluster_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(representative, member) of `rep<TAB>member` lines."""
    return spark.read.option("sep", "\t").schema("representative string, member string").csv(path)


def parse_clstr(lines: DataFrame) -> DataFrame:
    """(cluster, member, is_rep) of a block format: `>Cluster n` lines, members with `>name...`, `*` for the representative.

    ``lines``: value, ord. The block's number is carried forward over the lines.
    """
    head = F.regexp_extract("value", r"^>Cluster\s+(\d+)", 1)
    block = F.last(F.when(head != "", head.cast("int")), True).over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("cluster", block).withColumn("member", F.regexp_extract("value", r">([^>]+?)\.\.\.", 1))
    return rows.where(~F.col("value").startswith(">Cluster") & (F.col("member") != "")).select("cluster", "member", F.rtrim("value").endswith("*").alias("is_rep"))


def parse_domtblout(lines: DataFrame) -> DataFrame:
    """Profile hits of a domain table; short and comment lines are skipped."""
    f = F.split(F.trim("value"), r"\s+", 23)
    cols = {"target": (0, "string"), "target_acc": (1, "string"), "hmm_len": (2, "int"), "query": (3, "string"), "query_len": (5, "int"), "evalue": (6, "double"), "full_score": (7, "double"), "dom_evalue": (12, "double"), "dom_score": (13, "double"), "hmm_from": (15, "int"), "hmm_to": (16, "int"), "ali_from": (17, "int"), "ali_to": (18, "int")}
    out = lines.where(~F.col("value").startswith("#") & (F.size(f) >= 22)).select(*(F.expr(f"try_cast(element_at(split(trim(value), '\\\\s+', 23), {i + 1}) as {k})").alias(n) for n, (i, k) in cols.items()))
    return out.where("hmm_len is not null and dom_evalue is not null and ali_to is not null").withColumn("ali_span", F.col("ali_to") - F.col("ali_from") + 1)


def parse_ga_cutoffs(lines: DataFrame) -> DataFrame:
    """(name, cutoff) of a profile file: the second number of each GA line, or null. ``lines``: value, ord."""
    name = F.nullif(F.regexp_extract("value", r"^NAME\s+(\S+)", 1), F.lit(""))
    carried = F.last(name, True).over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    ga = F.regexp_extract("value", r"^GA\s+\S+\s+([-\d.]+)", 1)
    return lines.withColumn("name", carried).where("name is not null").groupBy("name").agg(F.max(F.nullif(ga, F.lit("")).cast("double")).alias("cutoff"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, ord): the lines of one file in order, read by one task; for small tool outputs."""
    return spark.read.text(path).coalesce(1).withColumn("ord", F.monotonically_increasing_id())
