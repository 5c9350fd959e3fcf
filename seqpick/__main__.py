"""Commands: ``python -m seqpick MODE -i a.fasta -o out -n 5``; `stats`, `doctor`, `cache`, `init-config`, `replay`.

Inputs are FASTA or Parquet paths that Spark can open. A configuration file (YAML or JSON) holds keys of
``plans.pipeline.Config``; options on the command line win.
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import stats
from .operators import reports
from .operators.markers import Spec
from .plans import outputs, pipeline
from .schema import REPORT_RANKS, as_records, rank
from .sources import fasta, stores, tables

FIELDS = ["organism", "accession", "strain", "host", "subtype", "collection_date", "country", "segment", "isolate_id"]


def session() -> SparkSession:
    return SparkSession.builder.appName("seqpick").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def load_config(path: str | None) -> dict:
    """Keys of a YAML or JSON file."""
    if not path:
        return {}
    with open(path) as fh:
        text = fh.read()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def read_inputs(spark: SparkSession, paths: list[str], source: str | None = None) -> DataFrame:
    """Records of all inputs; each path is checked before any is read."""
    texts = [p for p in paths if not p.rstrip("/").endswith(".parquet")]
    fasta.preflight(spark, texts)
    parts = [fasta.read_fasta(spark, texts, source)] if texts else []
    parts += [as_records(spark.read.parquet(p)) for p in paths if p not in texts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def make_config(args: argparse.Namespace) -> pipeline.Config:
    given = load_config(args.config)
    given["mode"] = args.command
    given |= {k: v for k in ("n", "threshold", "rank", "window", "overflow", "backend") if (v := getattr(args, k, None)) is not None}
    if args.command == "taxonomic2":
        given["ranks"] = parse_ranks(args.ranks)
    if args.command == "custom":
        given["fields"] = [args.field]
        if args.field_regex:
            given["field_regexes"] = {args.field: args.field_regex}
    if args.command == "hybrid":
        given["fields"] = [f.strip() for f in args.fields.split(",") if f.strip()]
        if args.field_regex:
            given["field_regexes"] = dict(x.split("=", 1) for x in args.field_regex)
    if args.annotate_field:
        given["annotate"] = args.annotate_field
    if "specs" in given:
        given["specs"] = [s if isinstance(s, Spec) else Spec(**{k: tuple(v) if isinstance(v, list) else v for k, v in s.items()}) for s in given["specs"]]
    if args.command == "global" and args.n is None and args.threshold is None:
        raise ValueError("global needs --threshold or -n")
    return pipeline.Config.from_dict(given)


def parse_ranks(text: str) -> dict[str, int]:
    """`family:20,genus:5`, or a JSON list of {rank, n_per_group}."""
    if text.lstrip().startswith("["):
        return {x["rank"]: int(x["n_per_group"]) for x in json.loads(text)}
    return {k.strip(): int(v) for k, v in (x.split(":") for x in text.split(","))}


def select_command(args: argparse.Namespace) -> int:
    cfg = make_config(args)
    if args.dry_run:
        print("configuration is valid")
        return 0
    spark = session()
    ids = lambda p: tables.read_ids(spark, p) if p else None
    table = tables.read_metadata(spark, args.metadata_table) if args.metadata_table else None
    if cfg.annotate:
        if table is None:
            raise ValueError("annotated fields need a metadata table")
        outputs.check_labels(cfg.annotate, [c for c in table.columns if c != "row_id"])
    records = read_inputs(spark, args.input, args.source)
    result = pipeline.run(records, cfg, table, ids(args.exclude_ids), ids(args.protect_ids), ids(args.pin_ids))
    outputs.write_all(spark, result, cfg, args.output_dir, args.input)
    print(outputs.summary(result, cfg))
    return 0


def profile(spark: SparkSession, df: DataFrame, top: int = 10) -> str:
    """Sources, lengths, how far fields are filled, and the commonest taxa of each rank."""
    lines = [f"{df.count()} records"]
    lines += [f"source {r.source}: {r['count']}" for r in df.groupBy("source").count().orderBy(F.desc("count"), "source").collect()]
    q = df.select(F.length("sequence").alias("len")).agg(*stats.quartiles("len")).first()
    lines.append(f"length min {q['min']} max {q['max']} median {q['median']} iqr {q['iqr']}")
    lines += [f"{r.field}: {r.filled} of {r.n}" for r in reports.profile(df, FIELDS).collect()]
    counts = reports.tally(df, {r: rank("taxonomy", r) for r in REPORT_RANKS})
    for r in outputs.order_places(counts).where(F.col("place") <= top).orderBy("rank", "place").collect():
        lines.append(f"{r['rank']} {r.taxon}: {r.n}")
    return "\n".join(lines)


def cache_command(args: argparse.Namespace) -> int:
    cache = stores.Cache(session(), args.path, args.ttl_days)
    if args.action == "stats":
        for r in cache.stats().orderBy("source").collect():
            print(r.source, r.n)
    elif args.action == "clear":
        print(cache.clear(args.source), "removed")
    else:
        print(cache.purge_expired(), "removed")
    return 0


def replay_command(args: argparse.Namespace) -> int:
    """Takes a lockfile's representatives from the inputs; ids that are missing go to a table of their own."""
    spark = session()
    _, locked = stores.read_lockfile(spark, args.lockfile)
    found, missing = stores.replay(locked, read_inputs(spark, args.input))
    fasta.write_fasta(found, f"{args.output_dir}/representatives.fasta")
    stores.write_tsv(missing, f"{args.output_dir}/missing")
    print(found.count(), "found,", missing.count(), "missing")
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seqpick", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for mode in pipeline.MODES:
        p = sub.add_parser(mode)
        p.add_argument("-i", "--input", action="append", required=True)
        p.add_argument("-o", "--output-dir", required=True)
        p.add_argument("-c", "--config")
        p.add_argument("--source", choices=["uniprot", "ncbi", "ncbi_virus"])
        p.add_argument("--overflow", choices=["trim", "keep"])
        p.add_argument("--backend", choices=["setcover", "greedy"])
        p.add_argument("--metadata-table", "--annotate-table")
        p.add_argument("--annotate-field", action="append")
        for name in ("exclude", "protect", "pin"):
            p.add_argument(f"--{name}-ids")
        p.add_argument("--dry-run", action="store_true")
        if mode != "taxonomic2":
            p.add_argument("-n", type=int, required=mode != "global")
        if mode == "global":
            p.add_argument("-T", "--threshold", type=float)
        if mode == "taxonomic1":
            p.add_argument("-r", "--rank", required=True)
        if mode == "taxonomic2":
            p.add_argument("-r", "--ranks", required=True)
        if mode == "time":
            p.add_argument("--window", default="year")
        if mode == "custom":
            p.add_argument("-f", "--field", required=True)
            p.add_argument("--field-regex")
        if mode == "hybrid":
            p.add_argument("-f", "--fields", required=True)
            p.add_argument("--field-regex", action="append", help="FIELD=PATTERN")
        p.set_defaults(run=select_command)
    p = sub.add_parser("stats")
    p.add_argument("-i", "--input", action="append", required=True)
    p.add_argument("--top-n", type=int, default=10)
    p.set_defaults(run=lambda a: print(profile(session(), read_inputs(session(), a.input), a.top_n)) or 0)
    p = sub.add_parser("doctor")
    p.set_defaults(run=lambda a: print("\n".join(f"{k}: {v}" for k, v in pipeline.doctor(session()).items())) or 0)
    p = sub.add_parser("cache")
    p.add_argument("action", choices=["stats", "clear", "purge-expired"])
    p.add_argument("path")
    p.add_argument("--source")
    p.add_argument("--ttl-days", type=float, default=30.0)
    p.set_defaults(run=cache_command)
    p = sub.add_parser("init-config")
    p.set_defaults(run=lambda a: print(json.dumps({k: v for k, v in dataclasses.asdict(pipeline.Config()).items()}, indent=2)) or 0)
    p = sub.add_parser("replay")
    p.add_argument("lockfile")
    p.add_argument("-i", "--input", action="append", required=True)
    p.add_argument("-o", "--output-dir", required=True)
    p.set_defaults(run=replay_command)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(args)
    except (ValueError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
