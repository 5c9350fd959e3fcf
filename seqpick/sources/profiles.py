"""Databases of profiles: a file, a folder of files or the name of a shipped set, read as one table of profiles."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.markers import Spec, parse_token
from ..operators.polyprotein import Polyprotein


def read_profiles(spark: SparkSession, database: str | None = None, shipped: str | None = None) -> DataFrame:
    """(file, place, name, accession, length, cutoff, body) of a database, in the order of file and place.

    A path is a file or a folder, of which the `.hmm` files count; what is no path is a set below ``shipped``, and None all of
    ``shipped``. ValueError where nothing is found. Files are split between tasks at the ends of profiles.
    """
    tried = [p for p in ((database, shipped and database and f"{shipped.rstrip('/')}/{database}") if database else (shipped,)) if p]
    for path in tried:
        try:
            raw = spark.read.option("lineSep", "\n//").text(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        out = _parsed(raw, path)
        if out.isEmpty():
            raise ValueError(f"{path} holds no profiles")
        return out
    raise ValueError(f"no database of profiles: {' or '.join(tried) or 'neither given nor shipped'}")


def _parsed(raw: DataFrame, path: str) -> DataFrame:
    own = F.lit("/" + path.rstrip("/").rpartition("/")[2])
    file = F.col("_metadata.file_path")
    rows = raw.where(F.endswith(file, F.lit(".hmm")) | F.endswith(file, own)).select(
        F.col("_metadata.file_name").alias("file"), (F.col("_metadata.file_block_start") + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33))).alias("place"), F.regexp_replace("value", r"\A\s+", "").alias("body"),
    )
    head = F.split("body", r"(?m)^HMM\s", 2)[0]
    first = lambda pattern: F.nullif(F.regexp_extract(head, pattern, 1), F.lit(""))
    return rows.select(
        "file", "place", first(r"(?m)^NAME\s+(\S+)").alias("name"), first(r"(?m)^ACC\s+(\S+)").alias("accession"), first(r"(?m)^LENG\s+(\d+)").cast("int").alias("length"),
        first(r"(?m)^GA\s+\S+\s+([-\d.]+)").cast("double").alias("cutoff"), F.rtrim("body").alias("body"),
    ).where("name is not null")


def write_profiles(profiles: DataFrame, path: str) -> None:
    """One database: part files whose names' order is that of the profiles. An existing folder is an error."""
    profiles.orderBy("file", "place").select(F.concat("body", F.lit("\n//")).alias("value")).write.mode("errorifexists").text(path)


def fingerprint(profiles: DataFrame) -> dict:
    """sha256 over the profiles' own hashes, whatever files they stand in, and how many there are."""
    each = profiles.select("name", F.sha2("body", 256).alias("h"))
    row = each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "h"))), lambda x: F.concat_ws(" ", x["name"], x["h"])), "\n"), 256).alias("sha256"), F.count("*").alias("n_profiles")).first()
    return row.asDict()


def _tokens(specs: Iterable[Spec], poly: Iterable[Polyprotein]) -> list[str]:
    return [t for s in specs for t in s.hmms] + [t for p in poly for q in p.peptides for t in q.tokens]


def needs_scan(specs: Iterable[Spec] = (), poly: Iterable[Polyprotein] = ()) -> bool:
    """Whether anything configured reads profile hits; else a scan is left out."""
    return any(t.strip() for t in _tokens(specs, poly))


def needed(specs: Iterable[Spec] = (), poly: Iterable[Polyprotein] = ()) -> set[str]:
    """Names of all profiles in the tokens; malformed ones are reported where specs are checked."""
    out: set[str] = set()
    for t in _tokens(specs, poly):
        try:
            out.update(parse_token(t))
        except ValueError:
            continue
    return out


def unknown(profiles: DataFrame, specs: Iterable[Spec] = (), poly: Iterable[Polyprotein] = ()) -> DataFrame:
    """(name): profiles that the configuration names and the database lacks."""
    names = profiles.sparkSession.createDataFrame([(n,) for n in sorted(needed(specs, poly))], "name string")
    return names.join(profiles, "name", "left_anti")


def lacks_proteins(proteins: str = "proteins") -> Column:
    """Records whose proteins were never looked up and could be: an accession, and not from a protein database."""
    return F.col(proteins).isNull() & (F.trim(F.coalesce("accession", F.lit(""))) != "") & ~F.coalesce(F.col("source") == "uniprot", F.lit(False))


def attach_missing(df: DataFrame, fetched: DataFrame) -> DataFrame:
    """``df`` with proteins from ``fetched`` (accession, proteins) where it lacks them, and nowhere else: hits that records carry stay.

    Records that lack none meet no key; they are spread by their ids.
    """
    from ..operators.bind import known_join

    key = F.when(lacks_proteins(), F.col("accession"))
    side = fetched.groupBy("accession").agg(F.first("proteins", ignorenulls=True).alias("_fetched"))
    had = df.columns
    out = known_join(df.withColumn("_key", key), side.withColumnRenamed("accession", "_key"), "_key")
    kind = df.schema["proteins"].dataType
    return out.withColumn("proteins", F.coalesce("proteins", F.col("_fetched").cast(kind))).select(*had)
