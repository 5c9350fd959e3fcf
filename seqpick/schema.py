"""The record schema and the ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranks with a field of their own, coarse to fine.
STANDARD_RANKS = ["superkingdom", "kingdom", "phylum", "class", "order", "family", "genus", "species"]
#: The ladder that reports tally, fine to coarse.
REPORT_RANKS = ["species", "subgenus", "genus", "subfamily", "family", "suborder", "order", "subclass", "class"]

HIT = "struct<target:string,hmm_len:int,dom_evalue:double,dom_score:double,hmm_from:int,hmm_to:int,ali_from:int,ali_to:int,ali_span:int,passing:boolean>"
PROTEIN = f"struct<protein_id:string,product:string,length:int,sequence:string,hmm_hits:array<{HIT}>>"
TAXONOMY = "struct<taxid:int," + ",".join(f"{r}:string" for r in STANDARD_RANKS) + ",lineage:map<string,string>>"
#: Column name to type, in order; `input_ord` replaces list order, and every "first seen wins" ends in it.
RECORD = {
    "id": "string", "header": "string", "sequence": "string", "seq_type": "string", "source": "string",
    "accession": "string", "organism": "string", "description": "string", "strain": "string", "host": "string",
    "subtype": "string", "collection_date": "string", "country": "string", "segment": "string",
    "isolate_id": "string", "isolate_id_source": "string", "is_refseq": "boolean", "is_reviewed": "boolean",
    "taxonomy": TAXONOMY, "proteins": f"array<{PROTEIN}>", "protein_sequence": "string",
    "marker_protein_ids": "array<string>", "group_labels": "map<string,string>", "input_ord": "bigint",
}


def as_records(df: DataFrame) -> DataFrame:
    """``df`` with every record column: those it lacks are null (flags false). Other columns stay behind them."""
    have = {c.lower(): c for c in df.columns}
    cols = []
    for name, kind in RECORD.items():
        default = F.lit(False) if kind == "boolean" else F.lit(None)
        cols.append((F.col(have[name]) if name in have else default).cast(kind).alias(name))
    return df.select(*cols, *(c for low, c in have.items() if low not in RECORD))


def filled(c: Column) -> Column:
    """Null for a blank string."""
    return F.when(F.trim(c) != "", c)


def rank(taxonomy: str, name: str) -> Column:
    """A rank's label: a standard rank has its field alone, any other the lineage map alone."""
    t = F.col(taxonomy)
    return filled(t[name]) if name in STANDARD_RANKS else filled(F.try_element_at(t["lineage"], F.lit(name)))


def free_name(taken: list[str], base: str) -> str:
    """``base``, or with underscores before it, so that no column in ``taken`` has the name (in any case)."""
    low = {x.lower() for x in taken}
    while base.lower() in low:
        base = "_" + base
    return base
