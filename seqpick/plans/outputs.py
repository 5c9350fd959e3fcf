"""The tables and files of a run. Every function returns a DataFrame; ``write_all`` puts them into one folder."""

from __future__ import annotations

import json
import re
from html import escape

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import alarms, cover, reports, select
from ..schema import REPORT_RANKS, filled, rank
from ..sources import fasta, stores
from .pipeline import Config, Result

#: Columns of the representative table, tag names that labels may not take.
REPRESENTATIVE = ["isolate_id", "isolate_id_source", "organism", "strain", "host", "subtype", "collection_date", "country", "n_segments", "segments", "accessions", "total_length_nt", "is_refseq", "is_reviewed", "ncbi_taxon_id", *REPORT_RANKS]
RESERVED = {*REPORT_RANKS, "organism", "ncbi_taxon_id", "isolate", "segment", "length", "hmmscan", "parent", "polyprotein", "peptide", "peptide_range_aa", "cut_method", "matched_arch", "host", "subtype", "collection_date", "country", "strain", "isolate_id", "year", "is_representative", "nuc_acc", "protein_acc", "protein_names"}


def representatives(reps: DataFrame) -> DataFrame:
    """The same columns for single and assembled records; what a record has no notion of is null."""
    parts = F.col("concat_segments") if "concat_segments" in reps.columns else F.lit(None).cast("array<struct<segment:string,accession:string,id:string,length:int>>")
    some = parts.isNotNull()
    join = lambda c: F.array_join(F.transform(parts, lambda p: p[c]), ",")
    return reps.select(
        F.when(some, F.col("isolate_id")).alias("isolate_id"), F.when(some, F.col("isolate_id_source")).alias("isolate_id_source"), "organism", "strain", "host", "subtype", "collection_date", "country",
        F.when(some, F.size(parts)).alias("n_segments"), F.when(some, join("segment")).alias("segments"), F.when(some, join("accession")).otherwise(F.coalesce("accession", "id")).alias("accessions"),
        F.length("sequence").alias("total_length_nt"), "is_refseq", "is_reviewed", F.col("taxonomy.taxid").alias("ncbi_taxon_id"), *(rank("taxonomy", r).alias(r) for r in REPORT_RANKS),
    )


def proteins(reps: DataFrame) -> DataFrame:
    """A row for each protein of the representatives, with its parent and ranks."""
    carry = reps.select("id", "isolate_id", "segment", "organism", "proteins", *(rank("taxonomy", r).alias(r) for r in REPORT_RANKS))
    rows = reports.proteins_long(carry, ["id", "isolate_id", "segment", "organism", *REPORT_RANKS])
    return rows.select("id", "isolate_id", "segment", "organism", *REPORT_RANKS, "nth", "protein_id", "product", "length", reports.hit_cell(F.col("hmm_hits")).alias("hmmscan"))


def clusters(result: Result) -> DataFrame:
    """A row for each cluster: its representative, size, purity of species, genus and host, and lengths of its members."""
    pool = result.pool.select(F.col("id").alias("member_id"), "organism", "accession", "is_refseq", "is_reviewed", "host", F.length("sequence").cast("bigint").alias("len"), rank("taxonomy", "species").alias("species"), rank("taxonomy", "genus").alias("genus"))
    rows = result.clusters.withColumn("cluster_id", F.concat_ws("/", "stratum", "rep_id")).join(pool, "member_id")
    out = rows.where("is_rep").select("cluster_id", F.coalesce("accession", "member_id").alias("accession"), "organism", "is_refseq", "is_reviewed")
    for c in ("species", "genus", "host"):
        p = reports.purity(rows, "cluster_id", F.col(c), F.col("len") if c == "host" else None)
        more = ["size", "min_length", "max_length", "median_length"] if c == "host" else []
        out = out.join(p.select(F.col("cluster").alias("cluster_id"), F.round("purity", 3).alias(f"{c}_purity"), F.col("n_distinct").alias(f"{c}_distinct"), *more), "cluster_id", "left")
    return out


def group_counts(clusters: DataFrame, by: str, curve: DataFrame | None = None) -> DataFrame:
    """A row for each stratum: sizes before and after, cutoff, clusters before a trim, and a column for each cutoff of the curve."""
    out = clusters.groupBy("stratum").agg(F.count("*").alias("stratum_size_before"), F.count(F.when(F.col("is_rep"), 1)).alias("stratum_size_after"), F.max("cutoff").isNotNull().alias("clustered"), F.round(F.max("cutoff"), 4).alias("cutoff"), F.max("trimmed_from").alias("clusters_before_trim"))
    out = out.select(F.lit(by).alias("stratified_by"), *out.columns)
    if curve is not None:
        wide = curve.groupBy("stratum").pivot("cutoff").agg(F.max("n_clusters"))
        names = sorted((c for c in wide.columns if c != "stratum"), key=float, reverse=True)
        out = out.join(wide.select("stratum", *(F.col(f"`{c}`").alias(f"n_clusters_{float(c):g}") for c in names)), "stratum", "left")
    return out


def group_assignments(pool: DataFrame, fields: list[str], reps: DataFrame, stratum: Column | None = None) -> DataFrame:
    """A row for each record and field: value, where it came from, and whether the record represents its stratum.

    ``pool`` has a struct `group_<field>` for each field.
    """
    pairs = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(f).alias("stratified_by"), F.col(f"group_{f}.value").alias("value"), F.col(f"group_{f}.matched_by").alias("matched_by")) for i, f in enumerate(fields)))
    rows = pool.select("id", "isolate_id", "accession", (stratum if stratum is not None else F.lit(None)).cast("string").alias("stratum"), F.explode(pairs).alias("x"))
    flags = reps.select("id", F.lit(True).alias("is_representative")).distinct()
    out = rows.join(flags, "id", "left").select("x.ord", "x.stratified_by", F.coalesce("stratum", "x.value").alias("stratum"), "id", "isolate_id", "accession", "x.value", "x.matched_by", F.coalesce("is_representative", F.lit(False)).alias("is_representative"))
    return out.orderBy("ord", "stratum", F.desc("is_representative"), "id").drop("ord")


def tags(extra: dict[str, Column] | None = None, labels: bool = True) -> Column:
    """`[key=value]` tags of a protein header, blanks left out: identity, ranks, context, labels, then ``extra``."""
    fixed = {"organism": F.col("organism"), "ncbi_taxon_id": F.col("taxonomy.taxid").cast("string")} | {r: rank("taxonomy", r) for r in REPORT_RANKS} | {"isolate": F.col("isolate_id"), "segment": F.col("segment"), "host": F.col("host"), "subtype": F.col("subtype")}
    one = lambda k, v: F.when(filled(v).isNotNull(), F.concat(F.lit(f"[{k}="), F.regexp_replace(X.one_line(v), r"[\[\]]", ""), F.lit("]")))
    parts = [one(k, v) for k, v in fixed.items()]
    if labels:
        free = F.map_filter("group_labels", lambda k, v: (X.label_key(k) != "") & ~X.label_key(k).isin(*RESERVED) & (v != ""))
        parts.append(F.nullif(F.array_join(F.transform(F.array_sort(F.map_entries(free)), lambda e: F.concat(F.lit("["), X.label_key(e["key"]), F.lit("="), e["value"], F.lit("]"))), " "), F.lit("")))
    return F.concat_ws(" ", *parts, *(one(k, v) for k, v in (extra or {}).items()))


def protein_fasta(reps: DataFrame, specs: dict[str, list[str]] | None = None) -> DataFrame:
    """(spec, header, body) of every protein; with ``specs`` (name: product words) only those that match, once for each spec."""
    rows = reps.select("*", F.explode("proteins").alias("p")).where(filled(F.col("p.sequence")).isNotNull())
    if specs:
        hit = lambda words: F.expr(" OR ".join(f"lower(p.product) LIKE '%{w.lower()}%'" for w in words))
        pairs = F.array_compact(F.array(*(F.when(hit(w), F.lit(file_name(n))) for n, w in specs.items())))
        rows = rows.withColumn("spec", F.explode(pairs))
    else:
        rows = rows.withColumn("spec", F.lit("all"))
    head = F.concat_ws(" ", F.coalesce("p.protein_id", F.lit("unknown")), F.col("p.product"), tags({"length": F.length("p.sequence").cast("string"), "hmmscan": reports.hit_cell(F.col("p.hmm_hits")), "parent": F.coalesce("accession", "id")}))
    return rows.select("spec", head.alias("header"), F.col("p.sequence").alias("body"))


def file_name(name: str) -> str:
    """A spec's name as a file name."""
    return re.sub(r"[^A-Za-z0-9._-]+", "_", name.strip()).strip("_") or "unnamed"


def leaf_label(template: str, fields: dict[str, Column]) -> Column:
    """A display label from `{name}` fields; a blank one takes the separator before it along, or at the start the one after."""
    sep = "|;,/_-:"
    parts = re.split(r"\{([A-Za-z_]\w*)\}", template)
    out, pending = F.lit(parts[0]), F.lit(False)
    for name, after in zip(parts[1::2], parts[2::2], strict=True):
        value = fields.get(name.lower(), F.lit(None).cast("string"))
        if name.lower() == "strain" and "isolate_id" in fields:
            value = F.coalesce(filled(value), fields["isolate_id"])
        value = F.regexp_replace(F.trim(filled(value)), r"\s+", "_")
        blank = value.isNull()
        ends = F.length(out) > 0
        ends = ends & F.contains(F.lit(sep), F.right(out, F.lit(1)))
        pending = blank & ~ends
        out = F.when(blank, F.when(ends, F.substring(out, F.lit(1), F.length(out) - 1)).otherwise(out)).otherwise(F.concat(out, value))
        cut = after[1:] if after and after[0] in sep else after
        out = F.concat(out, F.when(pending, F.lit(cut)).otherwise(F.lit(after)))
    return out


def check_labels(fields: list[str], columns: list[str]) -> dict[str, str]:
    """Label key to table column; ValueError for a column that isn't there, has no letters, is reserved or collides."""
    have = {c.lower(): c for c in columns}
    out: dict[str, str] = {}
    if not fields:
        raise ValueError("a table without fields attaches nothing")
    for f in fields:
        if f.lower() not in have:
            raise ValueError(f"{f!r} is no column of the table: {', '.join(columns)}")
        key = re.sub(r"^[0-9_]+", "", re.sub(r"[^A-Za-z0-9]+", "_", f).strip("_").lower())
        if not key or key in RESERVED or key in out:
            raise ValueError(f"{f!r} can't be a label: its key {key!r} is " + ("empty" if not key else "reserved" if key in RESERVED else f"that of {out[key]!r}"))
        out[key] = have[f.lower()]
    return out


def flags(result: Result) -> DataFrame:
    """Alarms: taxa that lost all records at genus or above, strata whose count missed its target, ids that matched nothing."""
    lost = reports.eliminated(result.before, result.after).select(F.concat_ws(":", "rank", "taxon").alias("subject"), F.col("n").alias("detail"))
    missed = result.clusters.where("note is not null").select(F.col("stratum").alias("subject"), F.col("note").alias("detail")).distinct() if "note" in result.clusters.columns else result.before.select(F.col("rank").alias("subject"), F.col("taxon").alias("detail")).limit(0)
    away = result.audit.where("action = 'unavailable'").select(F.col("id").alias("subject"), F.col("action").alias("detail"))
    return reports.alarms(eliminated=lost, target=missed, unavailable=away)


def top_taxa(result: Result) -> DataFrame:
    """(rank, taxon, n, n_after): the most common taxa of each rank, and all that cleaning removed."""
    return reports.top_or_eliminated(result.before, result.after).select("rank", "taxon", "n", "n_after")


def alarm_table(result: Result, labels: dict[str, DataFrame] | None = None, walls: DataFrame | None = None, monophyly: DataFrame | None = None, distances: DataFrame | None = None, review: DataFrame | None = None, whole: str = "genome", rank: str = "genus") -> DataFrame:
    """All alarms of a run, from its own tallies and whatever tables of labels, peptides and trees are given."""
    parts = [alarms.lost_taxa(reports.eliminated(result.before, result.after))]
    parts += [alarms.lost_labels(d, name) for name, d in (labels or {}).items()]
    for d, f in ((walls, lambda d: alarms.walls(d, rank)), (monophyly, lambda d: alarms.broken_taxa(d, whole)), (distances, alarms.incongruent), (review, lambda d: alarms.contradicted(d, rank))):
        if d is not None:
            parts.append(f(d))
    return alarms.collect(*parts)


#: What ``write_all`` puts beside the page, and what it is.
FILES = {
    "representatives.fasta": "representatives", "proteins.fasta": "their proteins", "representative_sequences": "their descriptions", "clusters": "clusters and how pure they are", "group_counts": "strata before and after",
    "qc_removed": "what cleaning removed, and why", "overrides": "what was protected from it", "force_selected": "pins", "taxa.txt": "taxa before and after", "flags.txt": "alarms", "effective_config": "all settings", "lock": "what a replay needs",
}


def html(cfg: Config, told: DataFrame, files: dict[str, str], most: int = 200) -> str:
    """A page with the settings' mode, the first ``most`` alarms and an index of the files."""
    esc = lambda v: escape("" if v is None else str(v))
    rows = told.limit(most).collect()
    items = "".join(f'<li class="{esc(r.severity)}"><b>{esc(r.subject)}</b> {esc(r.message)}</li>' for r in rows) or "<li>No alarms.</li>"
    index = "".join(f'<tr><td><a href="{esc(k)}">{esc(k)}</a></td><td>{esc(v)}</td></tr>' for k, v in files.items())
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{esc(cfg.mode)}</title></head><body><h1>Mode {esc(cfg.mode)}, target {cfg.n}</h1><h2>Alarms</h2><ul>{items}</ul><h2>Files</h2><table>{index}</table></body></html>"


def summary(result: Result, cfg: Config) -> str:
    """A paragraph of methods and figures in Markdown."""
    lines = ["# Methods", "", f"Records were cleaned and reduced in mode `{cfg.mode}` with target {cfg.n}, backend `{cfg.backend}` and overflow `{cfg.overflow}`.", "", "| stage | reason | removed |", "|-|-|-|"]
    lines += [f"| {r.stage} | {plain_cell(r.reason)} | {r.n} |" for r in result.removed.groupBy("stage", X.short_reason(F.col("reason")).alias("reason")).agg(F.count("*").alias("n")).orderBy("stage", "reason").collect()]
    return "\n".join([*lines, "", f"Pool {result.pool.count()}, clusters {result.clusters.where('is_rep').count()}, representatives {result.representatives.count()}."])


def plain_cell(s: str | None) -> str:
    return (s or "").replace("|", "/")


def write_all(spark: SparkSession, result: Result, cfg: Config, path: str, inputs: list[str] | None = None) -> None:
    """All outputs below ``path``, which must not exist. The run's tables are computed once each, in the shared folder."""
    result = Result(*map(cover.cut, result))
    stores.write_tsv(result.removed, f"{path}/qc_removed")
    stores.write_tsv(result.protected, f"{path}/overrides")
    stores.write_tsv(result.audit, f"{path}/force_selected")
    stores.write_tsv(representatives(result.representatives), f"{path}/representative_sequences")
    stores.write_tsv(proteins(result.representatives), f"{path}/proteins")
    stores.write_tsv(clusters(result), f"{path}/clusters")
    if "cutoff" in result.clusters.columns:
        stores.write_tsv(group_counts(result.clusters, cfg.mode), f"{path}/group_counts")
    stores.write_tsv(flags(result), f"{path}/flags")
    fasta.write_fasta(result.representatives, f"{path}/representatives.fasta")
    fasta.write_fasta(protein_fasta(result.representatives), f"{path}/proteins.fasta", body="body", by=["spec"])
    select.display_order(result.clusters, result.pool, cfg.mode).write.mode("errorifexists").json(f"{path}/strata")
    reports.text_table(top_taxa(result), ["rank", F.desc("n"), "taxon"]).select("value").write.mode("errorifexists").text(f"{path}/taxa.txt")
    told = alarm_table(result)
    alarms.lines(told).select("value").write.mode("errorifexists").text(f"{path}/flags.txt")
    spark.createDataFrame([(json.dumps(cfg.effective(), sort_keys=True, default=str),)], "value string").write.mode("errorifexists").text(f"{path}/effective_config")
    spark.createDataFrame([(html(cfg, told, FILES),)], "value string").write.mode("errorifexists").text(f"{path}/report.html")
    stores.write_lockfile(spark, f"{path}/lock", cfg.effective(), inputs or [], result.representatives, command=cfg.mode)
    spark.createDataFrame([(summary(result, cfg),)], "value string").write.text(f"{path}/summary")


def order_places(rows: DataFrame) -> DataFrame:
    """Display order of a report: count down, then name."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("rank").orderBy(F.desc("n"), "taxon")))
