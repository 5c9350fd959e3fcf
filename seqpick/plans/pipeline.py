"""The record flow from configuration to tables: clean, enrich, assemble, select, report.

Stages are DataFrame functions in a fixed order, cheap ones first; nothing is collected but counts and the configuration.
"""

from __future__ import annotations

import difflib
from dataclasses import asdict, dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import bind, cluster, cover, isolates, markers, qc, reports, select
from ..schema import REPORT_RANKS, as_records, rank
from ..sources import stores

MODES = ("global", "taxonomic1", "taxonomic2", "host", "time", "geographic", "custom", "hybrid")


@dataclass
class Config:
    """Defaults are fixed values that change results. ``from_dict`` refuses unknown keys."""

    mode: str = "host"
    n: int = 5
    threshold: float | None = None
    rank: str = "genus"
    ranks: dict[str, int] = field(default_factory=dict)
    window: str | int = "year"
    fields: list[str] = field(default_factory=list)
    field_regexes: dict[str, str] = field(default_factory=dict)
    overflow: str = "trim"
    backend: str = "setcover"
    protein: bool = True
    priority: tuple[str, ...] = ("refseq", "reviewed_uniprot", "longest")
    qc: dict = field(default_factory=dict)
    protein_annotation: int | None = None
    protein_quality: float | None = None
    consistency_rank: str | None = None
    virus: dict | None = None
    extra_segments_action: str = "warn"
    strain_collision_action: str = "warn"
    segment_lengths: dict = field(default_factory=dict)
    specs: list[markers.Spec] = field(default_factory=list)
    require_met_start: bool = False
    annotate: list[str] = field(default_factory=list)

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}; one of {', '.join(MODES)}")
        if self.n < 1:
            raise ValueError("n is at least 1")
        if self.mode in ("custom", "hybrid") and not self.fields:
            raise ValueError(f"mode {self.mode} needs fields")
        if self.mode == "taxonomic2" and not self.ranks:
            raise ValueError("mode taxonomic2 needs ranks")
        if self.threshold is not None and not 0 < self.threshold <= 1:
            raise ValueError("threshold lies in (0, 1]")
        self.clustering()

    @classmethod
    def from_dict(cls, given: dict) -> Config:
        known = list(cls.__dataclass_fields__)
        for k in given:
            if k not in known:
                near = difflib.get_close_matches(k, known, 1)
                raise ValueError(f"unknown key {k!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
        return cls(**given)

    def effective(self) -> dict:
        """Every setting as it stands, defaults and all, without secrets."""
        return stores.without_secrets(asdict(self))

    def clustering(self) -> cluster.Config:
        return cluster.Config(backend=self.backend, protein=self.protein, overflow=self.overflow, priority=tuple(self.priority))


class Result(NamedTuple):
    """Tables of a run. Every input record is in exactly one of: the log, or a cluster."""

    pool: DataFrame
    clusters: DataFrame
    representatives: DataFrame
    removed: DataFrame
    protected: DataFrame
    audit: DataFrame
    before: DataFrame
    after: DataFrame


def group_key(df: DataFrame, cfg: Config, table: DataFrame | None = None) -> tuple[DataFrame, Column]:
    """Records and the Column that names their stratum."""
    if cfg.mode == "host":
        return df, select.by_host()
    if cfg.mode == "geographic":
        return df, select.by_country()
    if cfg.mode == "time":
        return df, select.by_time(cfg.window)
    if cfg.mode == "taxonomic1":
        return df, select.by_rank(cfg.rank)
    if cfg.mode in ("custom", "hybrid"):
        for f in cfg.fields:
            df = bind.resolve_field(df, f, table, cfg.field_regexes.get(f), f"group_{f}")
        if cfg.mode == "custom":
            bind.coverage(df, f"group_{cfg.fields[0]}")
            return df, F.col(f"group_{cfg.fields[0]}.value")
        return df, select.by_fields({f: F.col(f"group_{f}.value") for f in cfg.fields})
    return df, F.lit("all")


def run(records: DataFrame, cfg: Config, table: DataFrame | None = None, exclude: DataFrame | None = None, protect: DataFrame | None = None, pins: DataFrame | None = None, dimension: DataFrame | None = None) -> Result:
    """A whole run. ``table``: metadata; ``exclude``, ``protect``, ``pins``: id lists; ``dimension``: by accession, fills host, country and date."""
    df = as_records(records)
    if exclude is not None:
        df, _ = qc.blocklist(df, exclude)
    if dimension is not None:
        df = bind.enrich(df, dimension, "accession", [c for c in ("organism", "host", "country", "collection_date") if c in dimension.columns])
    ranks = {r: rank("taxonomy", r) for r in REPORT_RANKS}
    before = reports.tally(df, ranks)
    logs, held = [], []

    def put(stage: qc.Stage) -> DataFrame:
        logs.append(stage.removed)
        held.append(stage.protected)
        return stage.kept

    # duplicates among parts wait for assembly
    basic = dict(cfg.qc) | ({"remove_duplicates": False} if cfg.virus else {})
    df = put(qc.run_basic(df, basic, protect))
    if cfg.protein_annotation:
        df = put(qc.protein_count(df, cfg.protein_annotation, protect=protect))
    if cfg.consistency_rank and cfg.virus:
        df = put(qc.taxonomy_consistency(df, rank("taxonomy", cfg.consistency_rank), protect))
    if cfg.protein_quality is not None:
        df = put(qc.protein_quality(df, cfg.protein_quality, protect, bool(cfg.virus)))
    if cfg.specs:
        marked = markers.with_marker(df, cfg.specs, need_met=cfg.require_met_start)
        df = put(qc.gate(marked, "marker_quality", F.when(F.col("marker.reason").isNotNull(), F.concat_ws(":", F.lit("marker"), "marker.reason", "marker.marker")), protect))
        df = df.withColumn("protein_sequence", F.col("marker.sequence")).drop("marker")
    if cfg.virus:
        if cfg.strain_collision_action == "drop":
            df = put(isolates.drop_collisions(df))
        stage, _ = isolates.complete(df, cfg.virus, cfg.extra_segments_action)
        df = put(stage)
        if cfg.segment_lengths:
            df = put(isolates.part_lengths(df, cfg.segment_lengths, protect))
        df = as_records(isolates.assemble(df))
        df = put(qc.exact_duplicates(df))
    if table is not None and cfg.annotate:
        labelled = bind.bind_columns(df, table, cfg.annotate)
        pairs = F.map_from_entries(F.array(*(F.struct(F.lit(c).alias("key"), F.coalesce(F.col(f"bound_{c}")["value"], F.lit("Unknown")).alias("value")) for c in cfg.annotate)))
        df = labelled.withColumn("group_labels", bind.merge_labels(F.col("group_labels"), pairs)).select(*df.columns)

    # clusters, representatives and tallies all read the cleaned records
    df = cover.cut(df)
    body = "protein_sequence" if cfg.specs else "sequence"
    if cfg.mode == "global" and cfg.threshold is not None:
        clusters = select.global_threshold(df, cfg.threshold, cfg.clustering(), body)
    elif cfg.mode == "taxonomic2":
        edges = select.nested(df, [(select.by_rank(r), n) for r, n in cfg.ranks.items()], cfg.clustering(), body)
        clusters = edges.select(F.lit("nested").alias("stratum"), "rep_id", "member_id", (F.col("rep_id") == F.col("member_id")).alias("is_rep"))
    else:
        df, key = group_key(df, cfg, table)
        clusters = select.stratified(df, key, cfg.n, cfg.clustering(), body)
    audit = df.sparkSession.createDataFrame([], "id string, action string")
    if pins is not None:
        pinned, audit = select.force_select(clusters.select(F.concat_ws("/", "stratum", "rep_id").alias("cluster_id"), "member_id", "is_rep"), df, pins, tuple(cfg.priority))
        reps = df.join(pinned.where("is_rep").select(F.col("member_id").alias("id")), "id", "left_semi")
    else:
        reps = df.join(clusters.where("is_rep").select(F.col("rep_id").alias("id")), "id", "left_semi")
    union = lambda parts: parts[0] if len(parts) == 1 else union([parts[0].unionByName(parts[1]), *parts[2:]])
    return Result(df, clusters, reps, union(logs), union(held), audit, before, reports.tally(df, ranks))


def doctor(spark) -> dict[str, str]:
    """A self-test: versions, Arrow, SQL, and a table that is checkpointed in the shared folder and read again."""
    import pyarrow

    out = {"spark": spark.version, "pyarrow": pyarrow.__version__}
    out["arrow udf"] = "ok" if spark.range(3).mapInArrow(lambda it: it, "id long").count() == 3 else "failed"
    out["shared folder"] = "ok" if cover.cut(spark.range(3)).count() == 3 else "failed"
    out["sql"] = "ok" if spark.sql("select 1").first()[0] == 1 else "failed"
    return out
