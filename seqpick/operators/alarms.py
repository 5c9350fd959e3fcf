"""What of a run is worth a look: six kinds of alarms from the tables that the reports are made of, and their text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import REPORT_RANKS

#: From this normalised distance two trees are incongruent, from this strongly so; so many pairs are told.
INCONGRUENT, STRONGLY, PAIRS = 0.2, 0.5, 15
#: The sections of the text, in order.
SECTIONS = ("qc_drop", "label_drop", "polyprotein_wall", "reassortment", "monophyly", "taxonomy")
TITLES = {
    "qc_drop": "Taxa that lost every record to cleaning", "label_drop": "Labels that lost every record to cleaning", "polyprotein_wall": "Taxa whose peptides are missing",
    "reassortment": "Signs of reassortment or recombination", "monophyly": "Taxa that the tree breaks up", "taxonomy": "Records whose taxon the tree contradicts",
}
COLUMNS = ("section", "severity", "category", "subject", "message", "o1", "o2")


def _rows(df: DataFrame, category: str, severity: Column | str, subject: Column, message: Column, o1: Column, o2: Column) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(F.lit(SECTIONS.index(category)).alias("section"), level.alias("severity"), F.lit(category).alias("category"), subject.cast("string").alias("subject"), message.alias("message"), o1.cast("double").alias("o1"), o2.cast("string").alias("o2"))


def _say(template: str, *cols: Column | str) -> Column:
    """The template with each `{}` replaced by a column's text; a null is empty."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for c, p in zip(cols, parts[1:], strict=True):
        out += [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")), F.lit(p)]
    return F.concat(*out)


def lost_taxa(eliminated: DataFrame) -> DataFrame:
    """From (rank, taxon, n) of taxa that had records before cleaning and have none after: ranks upward, the larger first."""
    place = F.array_position(F.array(*map(F.lit, REPORT_RANKS)), F.col("rank"))
    return _rows(eliminated, "qc_drop", "warn", _say("{} ({})", "taxon", "rank"), _say("{} ({}): all {} records of the input were removed by cleaning", "taxon", "rank", "n"), place * 1e12 - F.col("n"), F.col("taxon"))


def lost_labels(lost: DataFrame, label: str) -> DataFrame:
    """From (value, n, stage) of label values whose every record is in the removal log."""
    return _rows(lost, "label_drop", "warn", _say("{} (" + label + ")", "value"), _say("{} (" + label + "): all {} matched records were removed, most by {}", "value", "n", "stage"), -F.col("n"), F.concat(F.lit(label + " "), F.col("value")))


def walls(found: DataFrame, rank: str = "genus") -> DataFrame:
    """From ``reports.walls``: taxa that no spec slices, or whose home spec leaves most peptides without a hit."""
    none = F.col("covered") == 0
    message = F.when(none, _say("{} (" + rank + "): no spec cuts a peptide out of its {} representatives", "taxon", "n")).otherwise(
        _say("{} (" + rank + "): {} covers {} of {} peptides, {} are in none of {} representatives", "taxon", "home", "covered", "peptides", "zeros", "n")
    )
    return _rows(found.where("alarm"), "polyprotein_wall", "warn", _say("{} (" + rank + ")", "taxon"), message, F.lit(0), F.col("taxon"))


def broken_taxa(monophyly: DataFrame, whole: str) -> DataFrame:
    """From ``trees.monophyly``: taxa that the tree ``whole`` breaks up, and those that it holds together and another tree doesn't."""
    key = ["rank", "taxon"]
    on = F.col("tree") == whole
    intruders = F.coalesce(F.nullif(F.col("intruder_taxa"), F.lit("")), F.lit("unlabelled leaves"))
    subject, o2 = _say("{} ({})", "taxon", "rank"), F.concat_ws(" ", "rank", "taxon")
    poly = F.col("status") == "polyphyletic"
    message = F.when(poly, _say("{} ({}) is polyphyletic in the tree of whole records: {} leaves in {} blocks, between them {}", "taxon", "rank", "n_leaves", "n_clusters", intruders)).otherwise(
        _say("{} ({}) is paraphyletic in the tree of whole records, with {} inside", "taxon", "rank", intruders)
    )
    own = _rows(monophyly.where(on & F.col("status").isin("polyphyletic", "paraphyletic")), "monophyly", F.when(poly, "warn").otherwise("info"), subject, message, F.lit(0), o2)
    bad = F.when(~on & (F.col("status") != "monophyletic"), F.col("tree"))
    per = monophyly.groupBy(*key).agg(F.max(on & (F.col("status") == "monophyletic")).alias("whole"), F.array_join(F.array_sort(F.collect_set(bad)), ", ").alias("broken")).where("whole and broken <> ''")
    return own.unionByName(_rows(per, "reassortment", "warn", subject, _say("{} ({}) is one clade in the tree of whole records, but not in {}", "taxon", "rank", "broken"), F.lit(-1), o2))


def incongruent(distances: DataFrame) -> DataFrame:
    """From ``trees.rf_distances``: the farthest pairs of trees, of those far enough apart."""
    far = distances.where(F.col("norm_rf") >= INCONGRUENT).orderBy(F.desc("norm_rf"), "tree_a", "tree_b").limit(PAIRS)
    strength = F.when(F.col("norm_rf") >= STRONGLY, "strongly").otherwise("notably")
    return _rows(far, "reassortment", "warn", F.concat_ws(" / ", "tree_a", "tree_b"), _say("Trees {} and {} disagree {}: normalised distance {} over {} common leaves", "tree_a", "tree_b", strength, F.format_string("%.2f", F.col("norm_rf").cast("double")), "n_common"), 1 - F.col("norm_rf"), F.concat_ws(" ", "tree_a", "tree_b"))


def contradicted(review: DataFrame, rank: str) -> DataFrame:
    """From ``trees.review``: leaves that have a label and stand in a clade of another; blanks that it would fill are no alarm."""
    rows = review.where("action = 'conflict'")
    return _rows(rows, "taxonomy", "warn", F.col("leaf"), _say("{}: " + rank + " is {}, its clade says {} (share {})", "leaf", "own", "value", F.format_string("%.2f", F.col("share").cast("double"))), F.lit(0), F.concat_ws(" ", "tree", "leaf"))


def collect(*parts: DataFrame) -> DataFrame:
    """(section, severity, category, subject, message) of all parts, in the order of the text."""
    return reduce(DataFrame.unionByName, parts).orderBy("section", "o1", "o2").drop("o1", "o2")


def lines(alarms: DataFrame) -> DataFrame:
    """(section, place, value): the text of collected alarms. Warnings begin with `!`, the rest with `-`; a run without alarms says so."""
    s = alarms.sparkSession
    titles = s.createDataFrame([(i, f"## {TITLES[c]}") for i, c in enumerate(SECTIONS)], "section int, title string")
    heads = titles.join(alarms.select("section").distinct(), "section", "left_semi").select("section", F.lit("").alias("place"), F.col("title").alias("value"))
    body = alarms.select("section", F.concat_ws(" ", "category", "subject", "message").alias("place"), F.concat(F.when(F.col("severity") == "warn", "! ").otherwise("- "), F.col("message")).alias("value"))
    none = s.range(1).join(alarms.limit(1).select(F.lit(0).cast("long").alias("id")), "id", "left_anti").select(F.lit(0).alias("section"), F.lit("").alias("place"), F.lit("No alarms.").alias("value"))
    return heads.unionByName(body).unionByName(none).orderBy("section", "place")
