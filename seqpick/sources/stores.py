"""Key-value cache, lockfile and replay, dimension lookups, result tables."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CACHE = "source string, key string, value string, cached_at double, deleted boolean"
LOCK_VERSION = 1


class Cache:
    """A table keyed by (source, key) with JSON values and an age limit; writes append, the latest row counts."""

    def __init__(self, spark: SparkSession, path: str, ttl_days: float | None = 30.0, now=time.time):
        self.spark, self.path, self.ttl, self.now = spark, path, ttl_days, now

    def _rows(self) -> DataFrame:
        try:
            rows = self.spark.read.schema(CACHE).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], CACHE)
        last = Window.partitionBy("source", "key").orderBy(F.desc("cached_at"))
        return rows.withColumn("nth", F.row_number().over(last)).where("nth = 1 and not deleted").drop("nth", "deleted")

    def live(self) -> DataFrame:
        """(source, key, value, cached_at) not older than the limit: join a batch of keys to this."""
        rows = self._rows()
        return rows.where(F.col("cached_at") >= self.now() - self.ttl * 86400) if self.ttl else rows

    def get(self, source: str, key: str):
        row = self.live().where((F.col("source") == source) & (F.col("key") == key)).first()
        return json.loads(row.value) if row else None

    def put(self, rows: DataFrame) -> None:
        """``rows``: source, key, value (JSON; null is a cached absence)."""
        rows.select("source", "key", "value", F.lit(self.now()).alias("cached_at"), F.lit(False).alias("deleted")).write.mode("append").parquet(self.path)

    def set(self, source: str, key: str, value) -> None:
        self.put(self.spark.createDataFrame([(source, key, json.dumps(value))], "source string, key string, value string"))

    def _drop(self, rows: DataFrame) -> int:
        n = rows.count()
        if n:
            rows.select("source", "key", "value", F.lit(self.now()).alias("cached_at"), F.lit(True).alias("deleted")).write.mode("append").parquet(self.path)
        return n

    def delete(self, source: str, key: str) -> int:
        return self._drop(self._rows().where((F.col("source") == source) & (F.col("key") == key)))

    def clear(self, source: str | None = None) -> int:
        rows = self._rows()
        return self._drop(rows.where(F.col("source") == source) if source else rows)

    def purge_expired(self) -> int:
        return self._drop(self._rows().where(F.col("cached_at") < self.now() - self.ttl * 86400)) if self.ttl else 0

    def stats(self) -> DataFrame:
        """(source, n): entries by source."""
        return self._rows().groupBy("source").agg(F.count("*").alias("n"))


def input_hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, sha256, size) of whole files, each read by one task: up to 2 GB, what the reader takes of a file."""
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


ENTRY = "id string, kind string, accession string, isolate_id string, organism string, segment_accessions map<string,string>, group_labels map<string,string>, md5 string"
#: Endings of the names of settings that are never written.
SECRETS = ("api_key", "apikey", "email", "password", "secret", "_token")


def without_secrets(config):
    """A configuration of any depth without settings that are secrets or, by a leading underscore, private."""
    if isinstance(config, dict):
        return {k: without_secrets(v) for k, v in config.items() if not str(k).startswith("_") and not str(k).lower().endswith(SECRETS)}
    if isinstance(config, list | tuple):
        return [without_secrets(v) for v in config]
    return config


def tool_versions() -> dict[str, str]:
    """Versions of what a run's results rest on."""
    import platform
    from importlib.metadata import PackageNotFoundError, version

    out = {"python": platform.python_version()}
    for name in ("pyspark", "pyarrow", "pandas", "numpy"):
        try:
            out[name] = version(name)
        except PackageNotFoundError:
            out[name] = "not installed"
    return out


def representative_entries(reps: DataFrame) -> DataFrame:
    """(id, kind, accession, isolate_id, organism, segment_accessions, group_labels, md5): what a replay needs of each representative.

    An assembled record is an `isolate` and has the accessions of its parts; any other is a `sequence` and has its own.
    """
    have = set(reps.columns)
    parts = F.col("concat_segments") if "concat_segments" in have else F.lit(None).cast("array<struct<segment:string,accession:string>>")
    some = parts.isNotNull()
    named = F.array_distinct(F.transform(F.filter(parts, lambda p: p["segment"].isNotNull()), lambda p: p["segment"]))
    # the last of parts of one name counts
    of = F.map_from_arrays(named, F.transform(named, lambda n: F.element_at(F.filter(parts, lambda p: p["segment"] == n), -1)["accession"]))
    col = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind)
    labels = col("group_labels", "map<string,string>")
    return reps.select(
        "id", F.when(some, "isolate").otherwise("sequence").alias("kind"), F.when(~some, F.col("accession")).alias("accession"), F.when(some, col("isolate_id")).alias("isolate_id"), col("organism").alias("organism"),
        F.when(some, of).alias("segment_accessions"), F.when(F.size(labels) > 0, labels).alias("group_labels"), F.md5("sequence").alias("md5"),
    )


def write_lockfile(spark: SparkSession, path: str, config: dict, inputs: list[str], representatives: DataFrame, command: str = "", profiles: dict | None = None) -> None:
    """A JSON folder: the whole configuration without secrets, command, versions, hashes of inputs and profiles, an entry for each representative."""
    lock = {
        "version": LOCK_VERSION, "command": command, "config": without_secrets(config), "tools": tool_versions(), "profiles": profiles,
        "inputs": [r.asDict() for r in input_hashes(spark, inputs).collect()] if inputs else [],
    }
    head = spark.createDataFrame([(json.dumps(lock, sort_keys=True, default=str),)], "head string")
    head.write.mode("errorifexists").text(f"{path}/head")
    representative_entries(representatives).write.mode("errorifexists").json(f"{path}/representatives")


def read_lockfile(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    head = json.loads(spark.read.text(f"{path}/head").first()[0])
    if head.get("version") != LOCK_VERSION:
        raise ValueError(f"lockfile version {head.get('version')} is not {LOCK_VERSION}")
    return head, spark.read.schema(ENTRY).json(f"{path}/representatives")


def replay(locked: DataFrame, source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found records, missing ids): selection is taken from the lockfile, nothing is clustered anew."""
    keys = locked.select(F.col("id").alias("locked_id"), "md5").distinct()
    found = source.join(keys, F.col("id") == F.col("locked_id"), "left_semi")
    missing = keys.join(source, F.col("id") == F.col("locked_id"), "left_anti").select(F.col("locked_id").alias("id"), "md5")
    return found, missing


def write_tsv(df: DataFrame, path: str) -> None:
    """Cells on one line, booleans TRUE and FALSE; an existing folder is an error."""
    cell = lambda c, k: F.when(F.col(c), "TRUE").otherwise("FALSE") if k == "boolean" else F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]+", " ")
    df.select(*(F.coalesce(cell(c, k), F.lit("")).alias(c) for c, k in df.dtypes)).write.mode("errorifexists").option("sep", "\t").option("header", True).option("emptyValue", "").option("quote", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_tsv`` wrote, all columns as strings; empty cells are null, quotes plain characters."""
    reader = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("nullValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    return reader.csv(path)
