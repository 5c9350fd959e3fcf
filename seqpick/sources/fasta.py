"""FASTA scan and sink."""

from __future__ import annotations

from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import TAXONOMY, as_records, filled

#: Header patterns.
ACCESSION = r"^([A-Z_]+[\d_]+(?:\.\d+)?)\s"
UNIPROT = r"^(sp|tr)\|([A-Z0-9]+)\|(\S+)\s+(.*)$"
DATE = r"\[(\d{4}(?:-\d{2}(?:-\d{2})?)?)\]"
SEGMENT = r"(?i)\bsegment\s+(\w+)\b"
STRAIN_ANY = r"\(([AB]/[^/()]+/[^()]+)\)|([AB]/[^/\s(]+/[^/\s(]+/[^/\s(]+/[^/\s(]+)"
COUNTRY = r"^[A-Z][a-zA-Z\s]+(?::[A-Za-z\s]+)?$"
#: Characters that a body loses: blanks, carriage returns, gaps and stops.
STRIPPED = r"[ \r\n\-.*]"


def clean_body(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, STRIPPED, ""))


def header_fields(h: Column) -> Column:
    """A struct of what a header tells: UniProt, NCBI Virus, NCBI, or a plain one."""
    got = lambda c, p, i=1: filled(F.trim(F.regexp_extract(c, p, i)))
    null = F.lit(None).cast("string")

    def fields(source: str, accession: Column, description: Column, reviewed=F.lit(False), refseq=F.lit(False), **more: Column) -> Column:  # noqa: B008
        values = {"source": F.lit(source), "accession": accession, "description": description, "is_reviewed": reviewed, "is_refseq": refseq}
        values |= {k: more.get(k, null) for k in ("organism", "taxid", "strain", "collection_date", "segment", "country", "host")}
        return F.struct(*(v.cast("int" if k == "taxid" else "boolean" if k.startswith("is_") else "string").alias(k) for k, v in values.items()))

    # UniProt: the description ends where the first XX= tag begins
    rest = F.regexp_extract(h, UNIPROT, 4)
    uniprot = fields("uniprot", got(h, UNIPROT, 2), F.trim(F.regexp_replace(rest, r"\s*\b(?:OS|OX|GN|PE|SV)=.*$", "")), F.regexp_extract(h, UNIPROT, 1) == "sp", organism=got(rest, r"\bOS=([^=]+?)(?=\s+\w+=|$)"), taxid=got(rest, r"\bOX=(\d+)"))

    accession = got(h, ACCESSION)
    body = F.regexp_replace(h, ACCESSION, "")
    body = F.regexp_replace(body, r"^\s+", "")
    brackets = F.regexp_extract_all(body, F.lit(r"\[([^\]]+)\]"), F.lit(1))
    organism = F.get(F.filter(F.reverse(brackets), lambda b: b.rlike("^[A-Z][a-z]") & (F.size(F.split(F.trim(b), r"\s+")) >= 2)), F.lit(0))
    country = F.get(F.filter(brackets, lambda b: ~b.eqNullSafe(organism) & b.rlike(COUNTRY)), F.lit(0))
    host = F.get(F.filter(brackets, lambda b: ~b.eqNullSafe(organism) & ~b.eqNullSafe(country)), F.lit(0))
    virus = fields("ncbi_virus", accession, body, refseq=X.is_refseq(accession), organism=organism, strain=F.coalesce(got(body, STRAIN_ANY, 1), got(body, STRAIN_ANY, 2)), collection_date=got(body, DATE), segment=got(body, SEGMENT), country=country, host=host)

    tail = r"^(.*?)(?:\s+\[([^\]]+)\])?$"
    ncbi = fields("ncbi", accession, F.trim(F.regexp_extract(body, tail, 1)), refseq=X.is_refseq(accession), organism=got(body, tail, 2))
    plain = fields("unknown", filled(F.regexp_extract(h, r"^(\S+)", 1)), h)
    return F.when(h.rlike(UNIPROT), uniprot).when(accession.isNotNull() & (X.is_refseq(accession) | h.rlike(r"\[[^\]]+\].*\[[^\]]+\]")), virus).when(accession.isNotNull(), ncbi).otherwise(plain)


def parse_records(raw: DataFrame, source: str | None = None) -> DataFrame:
    """Raw `(header, body, input_ord)` as records. ``source`` overrides what the headers tell."""
    h = F.trim(F.regexp_replace("header", "^>+", ""))
    f = raw.withColumn("header", h).withColumn("f", header_fields(F.col("header"))).withColumn("sequence", clean_body(F.coalesce("body", F.lit(""))))
    taxid = F.col("f.taxid")
    tax = F.when(taxid.isNotNull(), F.from_json(F.to_json(F.struct(taxid.alias("taxid"))), TAXONOMY))
    out = f.select(
        F.coalesce("f.accession", F.regexp_extract("header", r"^(\S+)", 1)).alias("id"), "header", "sequence", X.seq_type(F.col("sequence")).alias("seq_type"),
        F.lit(source).alias("source") if source else F.col("f.source").alias("source"), "f.accession", "f.organism", "f.description", "f.strain", "f.host",
        "f.collection_date", "f.country", "f.segment", "f.is_refseq", "f.is_reviewed", tax.alias("taxonomy"), "input_ord",
    )
    return as_records(out)


#: From so many paths on one scan reads them all, if their names differ.
ONE_SCAN = 64


def read_fasta(spark: SparkSession, paths: list[str], source: str | None = None) -> DataFrame:
    """Records of all files, in order of path and place. Missing paths fail before anything is read; see ``preflight``.

    Records are cut at `>` at line starts by the text reader, so a large file is split between tasks.
    """
    # the place of the reader's block in the file and of the record in the block
    place = F.col("_metadata.file_block_start") + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33))
    read = lambda p: spark.read.option("lineSep", "\n>").text(p).select("value", place.alias("place"), F.col("_metadata.file_name").alias("file"))
    names = [PurePosixPath(p).name for p in paths]
    if len(paths) < ONE_SCAN or len(set(names)) < len(paths):
        raw = reduce(DataFrame.unionByName, (read(p).withColumn("nth", F.lit(i)) for i, p in enumerate(paths)))
    else:  # files are numbered by a table of their names
        raw = read(paths).join(F.broadcast(spark.createDataFrame(list(enumerate(names)), "nth int, file string")), "file")
    # the path's number leads: room for a million files of eight terabytes
    raw = raw.select("value", (F.col("nth").cast("bigint") * (1 << 43) + F.col("place")).alias("input_ord"))
    whole = F.regexp_replace("value", "^>", "")
    raw = raw.where(F.trim("value") != "").select(F.regexp_extract(whole, r"^([^\r\n]*)", 1).alias("header"), F.regexp_replace(whole, r"^[^\r\n]*[\r\n]*", "").alias("body"), "input_ord")
    return parse_records(raw, source)


def preflight(spark: SparkSession, paths: list[str]) -> None:
    """Readable errors for a missing, empty or foreign file, before a plan is built."""
    for path in paths:
        try:
            first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
        except Exception as e:
            raise FileNotFoundError(f"input not found: {path}") from e
        if not first:
            raise ValueError(f"input is empty: {path}")
        if not first[0][0].lstrip().startswith(">"):
            raise ValueError(f"not FASTA (the first line does not start with '>'): {path}")


def fasta_lines(header: Column, body: Column, width: int = 70) -> Column:
    """One FASTA entry: line breaks in the header as a blank, the body wrapped."""
    wrapped = F.regexp_replace(F.regexp_replace(body, f"(.{{{width}}})", "$1\n"), r"\n$", "")
    return F.concat(F.lit(">"), F.regexp_replace(header, r"[\r\n]+", " "), F.lit("\n"), wrapped)


def write_fasta(df: DataFrame, path: str, header: str = "header", body: str = "sequence", width: int = 70, by: list[str] | None = None) -> None:
    """Text files with an entry for each row; ``by``: a folder for each value, one output per marker or segment."""
    out = df.select(fasta_lines(F.col(header), F.col(body), width).alias("value"), *(by or []))
    writer = out.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).text(path)
