"""Answers of remote services as tables. Nothing is fetched here: payloads are a text column, parsed by built-in functions.

A payload that is null, empty or malformed gives nulls (Columns) or no rows (DataFrames).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import STANDARD_RANKS, TAXONOMY, filled

_NODE = "Rank:string,ScientificName:string"
_TAXA = f"Taxon array<struct<TaxId:int,{_NODE},LineageEx:struct<Taxon:array<struct<{_NODE}>>>>>"
_RANKED = "array<struct<rank:string,scientificName:string>>"
_ENTRY = """entryType string, organism struct<scientificName:string,taxonId:int,lineage:array<string>>, organismHosts array<struct<scientificName:string>>,
proteinDescription struct<recommendedName:struct<fullName:struct<value:string>>>"""
#: Fixed value: the type of an entry that a curator has seen.
REVIEWED = "UniProtKB reviewed (Swiss-Prot)"
#: Source qualifiers that the batch answers carry.
SOURCE = ("isolate", "strain", "segment", "serotype")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for a row: an expression put into several places is computed in each, and in a lambda for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _rank_map(pairs: Column, without: tuple[str, ...]) -> Column:
    """map(rank, name) of an array of structs (rank, name): lower case, blanks and unranked ones left out, the first of equal ranks."""
    clean = F.transform(F.coalesce(pairs, F.array().cast("array<struct<rank:string,name:string>>")), lambda p: F.struct(F.lower(F.trim(p["rank"])).alias("rank"), filled(F.trim(p["name"])).alias("name")))
    named = F.filter(clean, lambda p: (p["rank"] != "") & ~p["rank"].isin(*without) & p["name"].isNotNull())
    first = lambda n, ranks: F.map_from_entries(F.filter(n, lambda p, i: F.array_position(ranks, p["rank"]) == i + 1))
    return _once(named, lambda n: _once(F.transform(n, lambda p: p["rank"]), lambda ranks: first(n, ranks)))


def _taxonomy(taxid: Column, lineage: Column, species: Column | None = None) -> Column:
    at = lambda r: F.try_element_at(lineage, F.lit(r))
    named = {r: at(r) for r in STANDARD_RANKS}
    if species is not None:
        named["species"] = F.coalesce(named["species"], species)
    return F.struct(taxid.cast("int").alias("taxid"), *(c.alias(r) for r, c in named.items()), lineage.alias("lineage")).cast(TAXONOMY)


def taxonomy_xml(xml: Column, taxid: Column | None = None) -> Column:
    """The record's taxonomy from a taxonomy document: the ranks of the lineage, then the taxon's own. Null if it names no rank."""
    pair = lambda n: F.struct(n["Rank"].alias("rank"), n["ScientificName"].alias("name"))

    def of(taxon: Column) -> Column:
        above = F.coalesce(F.transform(taxon["LineageEx"]["Taxon"], pair), F.array().cast("array<struct<rank:string,name:string>>"))
        ranks = _rank_map(F.concat(above, F.array(pair(taxon))), ("no rank", "clade"))
        return _once(ranks, lambda lineage: F.when(F.size(lineage) > 0, _taxonomy(taxid if taxid is not None else taxon["TaxId"], lineage)))

    return _once(F.get(F.from_xml(xml, _TAXA)["Taxon"], F.lit(0)), of)


def taxonomy_json(json: Column, taxid: Column) -> Column:
    """As ``taxonomy_xml`` from a taxonomy answer in JSON; the last of equal ranks, and the taxon's name where no species is ranked."""
    p = F.from_json(json, f"scientificName string, lineage {_RANKED}")
    pairs = F.transform(F.reverse(p["lineage"]), lambda n: F.struct(n["rank"].alias("rank"), n["scientificName"].alias("name")))
    got = p["scientificName"].isNotNull() | p["lineage"].isNotNull()
    return F.when(got, _taxonomy(taxid, _rank_map(pairs, ("no rank",)), p["scientificName"]))


def entry_json(json: Column) -> Column:
    """struct(is_reviewed, organism, taxid, lineage_names, host, description) of a protein entry."""
    p = F.from_json(json, _ENTRY)
    o = p["organism"]
    return F.when(
        p["entryType"].isNotNull() | o.isNotNull(),
        F.struct(
            F.coalesce(p["entryType"] == REVIEWED, F.lit(False)).alias("is_reviewed"), o["scientificName"].alias("organism"), o["taxonId"].alias("taxid"), o["lineage"].alias("lineage_names"),
            F.get(p["organismHosts"], F.lit(0))["scientificName"].alias("host"), p["proteinDescription"]["recommendedName"]["fullName"]["value"].alias("description"),
        ),
    )


def summary_json(json: Column, uid: Column | None = None) -> Column:
    """struct(organism, taxid, title, host, country, collection_date, strain, subtype) of a summary answer, of ``uid`` or its first record.

    Source qualifiers come as two lists with bars between; the last of equal names counts.
    """

    def record(result: Column) -> Column:
        first = F.get(F.from_json(F.try_element_at(result, F.lit("uids")), "array<string>"), F.lit(0))
        return F.from_json(F.try_element_at(result, uid if uid is not None else first), "organism string, taxid string, title string, subtype string, subname string")

    def fields(rec: Column, pairs: Column) -> Column:
        def of(*names: str) -> Column:
            last = lambda n: F.try_element_at(F.filter(pairs, lambda p: (p["k"] == n) & p["v"].isNotNull()), F.lit(-1))["v"]
            return F.coalesce(*(F.nullif(last(n), F.lit("")) for n in names))

        return F.struct(
            rec["organism"].alias("organism"), F.nullif(rec["taxid"].try_cast("int"), F.lit(0)).alias("taxid"), rec["title"].alias("title"), of("host").alias("host"), of("geo_loc_name", "country").alias("country"),
            of("collection_date").alias("collection_date"), of("strain", "isolate").alias("strain"), of("serotype").alias("subtype"),
        )

    def whole(rec: Column) -> Column:
        pairs = F.arrays_zip(F.split(rec["subtype"], r"\|").alias("k"), F.split(rec["subname"], r"\|").alias("v"))
        return F.when(rec["organism"].isNotNull() | rec["taxid"].isNotNull() | rec["title"].isNotNull(), _once(pairs, lambda p: fields(rec, p)))

    return _once(F.from_json(json, "result map<string,string>")["result"], lambda result: _once(record(result), whole))


def _qualifier(feature: Column, name: str, glue: str = " ") -> Column:
    """The first value of a feature's qualifier, its lines joined, doubled quotes single; null if it has none."""
    pattern = rf'(?s)\n {{21}}/{name}=(?:"([^"]*+(?:""[^"]*+)*+)"|([^"\n][^\n]*))'
    raw = F.coalesce(F.nullif(F.regexp_extract(feature, pattern, 1), F.lit("")), F.nullif(F.trim(F.regexp_extract(feature, pattern, 2)), F.lit("")))
    return F.replace(F.regexp_replace(raw, r"\s*\n\s*", glue), F.lit('""'), F.lit('"'))


def flat_records(payloads: DataFrame) -> DataFrame:
    """(accession, source struct<isolate, strain, segment, serotype>, proteins) of each record in flat files. ``payloads``: value.

    The feature table is cut at its keys, in column 6; a protein is a coding feature, with its translation if there is one.
    """
    whole = F.regexp_replace("value", "\r\n?", "\n")
    one = payloads.select(F.explode(F.split(whole, r"(?m)^//[ \t]*$")).alias("r")).where(F.trim("r") != "")
    section = F.split("r", r"\n(?=\S)")
    table = F.coalesce(F.try_element_at(F.filter(section, lambda s: F.startswith(s, F.lit("FEATURES"))), F.lit(1)), F.lit(""))
    version, plain = (F.regexp_extract("r", rf"(?m)^{k}\s+(\S+)", 1) for k in ("VERSION", "ACCESSION"))
    rows = one.select(F.coalesce(F.nullif(version, F.lit("")), F.nullif(plain, F.lit(""))).alias("accession"), F.split(table, r"\n(?= {5}\S)").alias("f"))
    key = lambda name: F.filter("f", lambda f: F.rlike(f, F.lit(rf"^ {{5}}{name}\s")))
    # the last source feature speaks for the record
    source = F.try_element_at(key("source"), F.lit(-1))
    body = lambda f: _qualifier(f, "translation", "")
    protein = lambda f: F.struct(_qualifier(f, "protein_id").alias("protein_id"), _qualifier(f, "product").alias("product"), F.length(body(f)).alias("length"), body(f).alias("sequence"))
    return rows.where("accession is not null").select("accession", F.struct(*(_qualifier(source, q).alias(q) for q in SOURCE)).alias("source"), F.transform(key("CDS"), protein).alias("proteins"))


def bodies(payloads: DataFrame) -> DataFrame:
    """(accession, sequence) of FASTA answers: upper case, without gaps; records without a body are left out. ``payloads``: value."""
    one = payloads.select(F.explode(F.split(F.regexp_replace("value", "\r\n?", "\n"), r"(?:^|\n)>")).alias("r"))
    head = F.regexp_extract("r", r"^[^\S\n]*(\S+)", 1)
    body = F.upper(F.regexp_replace(F.regexp_replace("r", r"^[^\n]*\n?", ""), r"[\s-]", ""))
    return one.select(head.alias("accession"), body.alias("sequence")).where("accession <> '' and sequence <> ''")


def answers(wanted: DataFrame, parsed: DataFrame) -> DataFrame:
    """Each wanted accession once, with the columns of the record that answers it: the same accession, else one that differs in its version.

    ``wanted``: accession. Accessions without an answer have nulls. One shuffle on the accession without version.
    """
    cols = [c for c in parsed.columns if c != "accession"]
    bare = lambda c: F.substring_index(c, ".", 1)
    side = parsed.select(bare("accession").alias("_bare"), F.struct(F.col("accession").alias("_full"), *cols).alias("_r")).where("_bare is not null")
    both = wanted.select("accession").where("accession is not null").distinct().withColumn("_bare", bare("accession")).join(side, "_bare", "left")
    best = F.max_by("_r", F.struct((F.col("_r._full") == F.col("accession")), F.col("_r._full")))
    return both.groupBy("accession").agg(best.alias("_r")).select("accession", *(F.col("_r")[c].alias(c) for c in cols))


def chosen_models(reports: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """(path, part, model) that a tree builder's report names. ``reports``: path, value.

    Without ``labels`` the best model of the whole (`GENOME`); with them that of each row of the table of partitions, by its number.
    """
    if labels is None:
        by = [F.nullif(F.regexp_extract("value", p, 1), F.lit("")) for p in (r"(?m)^\s*Best-fit model according to BIC:\s*(\S+)\s*$", r"(?m)^\s*Best-fit model:\s*(\S+)\s+chosen according to")]
        return reports.select("path", F.lit("GENOME").alias("part"), F.coalesce(*by).alias("model")).where("model is not null")
    row = r"^\s*(\d+)\s+(\S+)\s"
    lines = F.split(F.try_element_at(F.split("value", r"(?m)^\s*ID\s+Model\b", 2), F.lit(2)), r"\r?\n")
    cut = reports.select("path", lines.alias("l")).where("l is not null").withColumn("ok", F.transform("l", lambda x: F.rlike(x, F.lit(row))))
    # the table: from the first row that is one to the first that isn't
    cut = cut.withColumn("first", F.array_position("ok", F.lit(True)).cast("int")).where("first > 0").withColumn("rest", F.slice("l", F.col("first"), F.size("l")))
    end = F.array_position(F.transform("rest", lambda x: F.rlike(x, F.lit(row))), F.lit(False)).cast("int")
    rows = F.when(end > 0, F.slice("rest", F.lit(1), end - 1)).otherwise(F.col("rest"))
    found = cut.select("path", F.posexplode(rows).alias("nth", "x")).select("path", "nth", F.regexp_extract("x", row, 1).cast("int").alias("id"), F.regexp_extract("x", row, 2).alias("model"))
    best = found.groupBy("path", "id").agg(F.max_by("model", "nth").alias("model"))
    return best.withColumn("part", F.get(F.array(*map(F.lit, labels)), F.col("id") - 1) if labels else F.lit(None).cast("string")).where("part is not null").select("path", "part", "model")


#: Folder endings and the role of the alignments in them.
ROLES = {"_per_protein": "marker", "_extra_protein": "extra_protein", "_polyprotein": "peptide", "_per_segment": "segment_nt"}


def alignment_role(path: Column, prefix: str) -> Column:
    """struct(role, label, untrimmed) that an alignment's path, relative to the run's folder, tells."""
    less = lambda c, start: F.when(F.startswith(c, F.lit(start)), F.substring(c, F.lit(len(start) + 1), F.length(c))).otherwise(c)
    short = lambda c, end: F.when(F.endswith(c, F.lit(end)), F.substring(c, F.lit(1), F.length(c) - len(end))).otherwise(c)
    parts = F.split(path, "/")
    stem = short(F.element_at(parts, -1), ".fasta")
    untrimmed = F.endswith(stem, F.lit("_untrimmed"))
    stem = short(stem, "_untrimmed")
    folder = F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2))
    inner = F.coalesce(*(F.when(F.endswith(folder, F.lit(e)), F.lit(r)) for e, r in ROLES.items()), less(folder, f"{prefix}_"))
    base = f"{prefix}_msa"
    family = F.startswith(stem, F.lit(f"{base}_"))
    role = F.when(folder.isNotNull(), inner).when(family, "partition_family").otherwise("genome")
    label = F.when(folder.isNotNull(), less(short(stem, "_msa"), f"{prefix}_")).when(stem == base, "").when(family, less(stem, f"{base}_")).otherwise(less(stem, f"{prefix}_"))
    return F.struct(role.alias("role"), label.alias("label"), untrimmed.alias("untrimmed"))
