"""Registered queries over payloads, alarms and the files of a run; the SQL tells the same rows from the tables they are built of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alarms, cluster, qc, reports, select
from ..operators.markers import Spec
from ..operators.polyprotein import Peptide, Polyprotein
from ..schema import PROTEIN, as_records
from ..sources import payloads, profiles, stores
from .catalogue import RECORDS, query, records, table
from .catalogue_inputs import _NATIONS, _folder, _nations, _people

_text = lambda c: F.col(c).cast("string")


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt out to tasks: payloads cost far more to parse than to read, and a small file is one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


@query(f"""SELECT c_custkey AS id, CAST(c_custkey + 9 AS INT) AS taxid, n_name AS genus, CASE WHEN c_custkey % 3 = 0 THEN r_name END AS family, 'sp ' || c_custkey AS species,
CAST(CASE WHEN c_custkey % 3 = 0 THEN 3 ELSE 2 END AS BIGINT) AS n_ranks FROM {_NATIONS} WHERE c_custkey % 7 <> 0""")
def q_taxonomy_xml(spark, sf_dir):
    """Ranks of a lineage and the taxon's own, the first of equal ones; every seventh payload is cut off and gives nothing."""
    key = F.col("c_custkey")
    node = lambda rank, name: F.concat(F.lit(f"<Taxon><Rank>{rank}</Rank><ScientificName>"), name, F.lit("</ScientificName></Taxon>"))
    line = F.concat(node("no rank", F.lit("cells")), F.when(key % 3 == 0, node("Family", F.col("r_name"))).otherwise(node("clade", F.col("r_name"))), node("genus", F.col("n_name")), node("genus", F.lit("second")))
    xml = F.concat(F.lit("<TaxaSet><Taxon><TaxId>"), (key + 9).cast("string"), F.lit("</TaxId><ScientificName>sp "), key.cast("string"), F.lit("</ScientificName><Rank>species</Rank><LineageEx>"), line, F.lit("</LineageEx></Taxon></TaxaSet>"))
    xml = F.when(key % 7 == 0, F.substring(xml, 1, 60)).otherwise(xml)
    some = F.filter(F.array(payloads.taxonomy_xml(xml)), lambda t: t.isNotNull())  # not a filter on the column: it would parse again
    rows = _dealt(_nations(spark, sf_dir), "c_custkey").select(key.alias("id"), F.explode(some).alias("t"))
    return rows.select("id", "t.taxid", "t.genus", "t.family", "t.species", F.size("t.lineage").cast("long").alias("n_ranks"))


@query(f"""SELECT c_custkey AS id, n_name || CASE WHEN c_custkey % 2 = 0 THEN ' (even)' ELSE '' END AS genus, c_custkey % 2 = 0 AS is_reviewed, n_name AS organism, CASE WHEN c_custkey % 3 > 0 THEN r_name END AS host, c_mktsegment AS description,
CAST(2 AS BIGINT) AS n_lineage FROM {_NATIONS}""")
def q_entry_json(spark, sf_dir):
    key = F.col("c_custkey")
    s = F.struct
    entry = F.to_json(s(
        F.when(key % 2 == 0, payloads.REVIEWED).otherwise("UniProtKB unreviewed (TrEMBL)").alias("entryType"), s(F.col("n_name").alias("scientificName"), key.alias("taxonId"), F.array("r_name", "n_name").alias("lineage")).alias("organism"),
        F.when(key % 3 > 0, F.array(s(F.col("r_name").alias("scientificName")), s(F.lit("later").alias("scientificName")))).alias("organismHosts"),
        s(s(s(F.col("c_mktsegment").alias("value")).alias("fullName")).alias("recommendedName")).alias("proteinDescription"),
    ))
    ranked = lambda r, n: s(F.lit(r).alias("rank"), n.alias("scientificName"))
    last = F.when(key % 2 == 0, F.concat("n_name", F.lit(" (even)"))).otherwise(F.col("n_name"))
    tax = F.to_json(s(F.lit("x").alias("scientificName"), F.array(ranked("genus", F.lit("first")), ranked("no rank", F.lit("y")), ranked("Genus", last)).alias("lineage")))
    rows = _nations(spark, sf_dir).select(key.alias("id"), payloads.entry_json(entry).alias("e"), payloads.taxonomy_json(tax, key).alias("t"))
    return rows.select("id", "t.genus", "e.is_reviewed", "e.organism", "e.host", "e.description", F.size("e.lineage_names").cast("long").alias("n_lineage"))


@query(f"""SELECT c_custkey AS id, n_name AS organism, CAST(nullif(c_custkey % 5, 0) AS INT) AS taxid, c_mktsegment AS host, r_name AS country, CASE WHEN c_custkey % 2 = 0 THEN 's' || c_custkey ELSE 'i' END AS strain, CAST(NULL AS VARCHAR) AS subtype FROM {_NATIONS}""")
def q_summary_json(spark, sf_dir):
    key = F.col("c_custkey")
    names = F.concat_ws("|", F.lit("host"), F.when(key % 3 == 0, "geo_loc_name").otherwise("country"), F.lit("isolate"), F.when(key % 2 == 0, "strain"), F.lit("serotype"))
    values = F.concat_ws("|", F.col("c_mktsegment"), F.col("r_name"), F.lit("i"), F.when(key % 2 == 0, F.concat(F.lit("s"), key.cast("string"))))
    rec = F.to_json(F.struct(F.col("n_name").alias("organism"), (key % 5).alias("taxid"), F.lit("t").alias("title"), names.alias("subtype"), values.alias("subname")))
    body = F.concat(F.lit('{"result": {"uids": ["'), key.cast("string"), F.lit('"], "'), key.cast("string"), F.lit('": '), rec, F.lit("}}"))
    return _dealt(_nations(spark, sf_dir), "c_custkey").select(key.alias("id"), payloads.summary_json(body).alias("e")).select("id", "e.organism", "e.taxid", "e.host", "e.country", "e.strain", "e.subtype")


@query("""SELECT 'P' || p_partkey || '.1' AS accession, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS strain, CAST(p_size AS VARCHAR) AS segment, 'q' || p_partkey AS protein_id, p_name AS product, CAST(CASE WHEN p_partkey % 2 = 0 THEN 32 END AS INT) AS length FROM part
UNION ALL SELECT 'P' || p_partkey || '.1', CASE WHEN p_partkey % 3 > 0 THEN p_brand END, CAST(p_size AS VARCHAR), NULL, 'a "second" one', NULL FROM part""")
def q_flat_records(spark, sf_dir):
    pad, key = " " * 21, _text("p_partkey")
    strain = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit(f'\n{pad}/strain="'), "p_brand", F.lit('"'))).otherwise("")
    body = F.md5("p_name")
    translation = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(f'\n{pad}/translation="'), F.left(body, F.lit(20)), F.lit(f"\n{pad}"), F.right(body, F.lit(12)), F.lit('"'))).otherwise("")
    flat = F.concat(
        F.lit("LOCUS       P\nVERSION     P"), key, F.lit(f".1\nFEATURES             Location/Qualifiers\n     source          1..9\n{pad}/organism=\"x\""), strain, F.lit(f"\n{pad}/segment="), _text("p_size"),
        F.lit(f'\n     CDS             join(1..2,\n{pad}4..9)\n{pad}/product="'), F.replace("p_name", F.lit(" "), F.lit(f"\n{pad}")), F.lit(f'"\n{pad}/protein_id="q'), key, F.lit('"'), translation,
        F.lit(f'\n     CDS             1..2\n{pad}/product="a ""second"" one"\nORIGIN\n        1 acgt\n//\n'),
    )
    got = payloads.flat_records(table(spark, sf_dir, "part").select(flat.alias("value")))
    return got.select("accession", "source.strain", "source.segment", F.explode("proteins").alias("p")).select("accession", "strain", "segment", "p.protein_id", "p.product", "p.length")


@query("""SELECT 's' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.1' ELSE '' END AS accession, CASE WHEN s_suppkey % 5 > 0 THEN upper(md5(s_name)) END AS sequence FROM supplier""")
def q_body_answers(spark, sf_dir):
    """Payloads carry version 1 of every accession; odd ones are asked for without a version, every fifth has no body."""
    s = table(spark, sf_dir, "supplier")
    text = F.concat(F.lit(">s"), _text("s_suppkey"), F.lit(".1 some words\n"), F.when(F.col("s_suppkey") % 5 > 0, F.concat(F.left(F.md5("s_name"), F.lit(9)), F.lit("-\r\n"), F.right(F.md5("s_name"), F.lit(23)))).otherwise(""), F.lit("\n"))
    wanted = s.select(F.concat(F.lit("s"), _text("s_suppkey"), F.when(F.col("s_suppkey") % 2 == 0, ".1").otherwise("")).alias("accession"))
    return payloads.answers(wanted, payloads.bodies(s.select(text.alias("value"))))


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS path, 'GENOME' AS part, 'M' || n_nationkey || '+G' AS model FROM nation
UNION ALL SELECT CAST(n_nationkey AS VARCHAR), unnest(['a', 'b']), unnest(['LG+' || n_regionkey, 'JTT']) FROM nation""")
def q_chosen_models(spark, sf_dir):
    text = F.concat(F.lit("Report\nBest-fit model according to BIC: M"), _text("n_nationkey"), F.lit("+G\n\n  ID  Model  Speed\n\n   1  LG+"), _text("n_regionkey"), F.lit("  1.0\n   2  JTT  1.0\n   3  unnamed  1.0\n\n   1  late  2\n"))
    files = table(spark, sf_dir, "nation").select(_text("n_nationkey").alias("path"), text.alias("value"))
    return payloads.chosen_models(files).unionByName(payloads.chosen_models(files, ["a", "b"]))


@query("""SELECT p_partkey AS id, ['genome', 'partition_family', 'marker', 'peptide'][p_partkey % 4 + 1] AS role, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'f' || p_size END AS label, p_partkey % 3 = 0 AS untrimmed FROM part""")
def q_alignment_roles(spark, sf_dir):
    key, name = F.col("p_partkey"), F.concat(F.lit("f"), _text("p_size"))
    path = F.when(key % 4 == 0, "run_msa").when(key % 4 == 1, F.concat(F.lit("run_msa_"), name)).when(key % 4 == 2, F.concat(F.lit("run_per_protein/"), name, F.lit("_msa"))).otherwise(F.concat(F.lit("run_polyprotein/run_"), name, F.lit("_msa")))
    path = F.concat(path, F.when(key % 3 == 0, "_untrimmed").otherwise(""), F.lit(".fasta"))
    return table(spark, sf_dir, "part").select(key.alias("id"), payloads.alignment_role(path, "run").alias("m")).select("id", "m.*")


@query(f"""WITH t AS (SELECT n_name || '/' || c_mktsegment AS taxon, count(*) AS n, count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 495000)) AS left_over FROM {_NATIONS} GROUP BY 1),
l AS (SELECT 'g' || (CAST(id AS BIGINT) % 300) AS value, count(*) AS n, bool_and(length(sequence) < 1200) AS gone FROM ({RECORDS}) GROUP BY 1),
w AS (SELECT source, count(*) AS n, CAST(sum(CAST(length(text) > 400 AS INT)) > 0 AS INT) + CAST(sum(CAST(length(text) > 100000000 AS INT)) > 0 AS INT) + CAST(sum(CAST(length(text) > 200000000 AS INT)) > 0 AS INT) AS covered FROM documents WHERE source IS NOT NULL GROUP BY 1)
SELECT 'qc_drop' AS category, 'warn' AS severity, taxon || ' (genus)' AS subject FROM t WHERE left_over = 0
UNION ALL SELECT 'label_drop', 'warn', value || ' (tens)' FROM l WHERE gone
UNION ALL SELECT 'polyprotein_wall', 'warn', source || ' (genus)' FROM w WHERE n >= 3 AND (3 - covered) / 3 >= 0.6""")
def q_alarms(spark, sf_dir):
    rows = _nations(spark, sf_dir)
    big = table(spark, sf_dir, "orders").where("o_totalprice > 495000").select(F.col("o_custkey").alias("c_custkey"))
    ranks = {"genus": F.concat_ws("/", "n_name", "c_mktsegment")}
    lost = reports.eliminated(reports.tally(rows, ranks), reports.tally(rows.join(big, "c_custkey", "left_semi"), ranks))
    docs = records(spark, sf_dir).withColumn("label", F.concat(F.lit("g"), (F.col("input_ord") % 300).cast("string")))
    gone = reports.lost_labels(docs, qc.length_bounds(docs, 1200, None).removed, "label")
    size = F.length("text")
    cells = F.array(*(F.struct(F.lit(n).alias("peptide"), (size > least).alias("has")) for n, least in (("a", 400), ("b", 100_000_000), ("c", 200_000_000))))
    peptides = table(spark, sf_dir, "documents").where("source is not null").select("source", F.lit("poly").alias("spec"), F.explode(cells).alias("x")).select("source", "spec", "x.*")
    walls = reports.walls(peptides, "source", "spec", F.col("has"))
    return alarms.collect(alarms.lost_taxa(lost), alarms.lost_labels(gone, "tens"), alarms.walls(walls)).select("category", "severity", "subject")


@query(f"""SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 3 = 0 THEN 'own' WHEN c_custkey % 5 > 0 AND c_custkey % 4 <> 1 THEN 'new' || c_custkey END AS protein_id FROM {_NATIONS}""")
def q_fetch_missing(spark, sf_dir):
    """A third has proteins, a quarter is of a protein database, a fifth is in no answer."""
    key = F.col("c_custkey")
    proteins = lambda name: F.from_json(F.to_json(F.array(F.struct(name.alias("protein_id")))), f"array<{PROTEIN}>")
    rows = _nations(spark, sf_dir)
    df = as_records(rows.select(key.cast("string").alias("id"), key.cast("string").alias("accession"), F.when(key % 4 == 1, "uniprot").otherwise("ncbi").alias("source"), F.when(key % 3 == 0, proteins(F.lit("own"))).alias("proteins"), key.alias("input_ord")))
    fetched = rows.where(key % 5 > 0).select(key.cast("string").alias("accession"), proteins(F.concat(F.lit("new"), key.cast("string"))).alias("proteins"))
    return profiles.attach_missing(df, fetched).select("id", F.get("proteins", F.lit(0))["protein_id"].alias("protein_id"))


@query("SELECT 'dom' || x AS name FROM (VALUES (1), (2), (49), (50), (51), (77)) v(x) WHERE x NOT IN (SELECT p_size FROM part)")
def q_unknown_profiles(spark, sf_dir):
    have = table(spark, sf_dir, "part").select(F.concat(F.lit("dom"), _text("p_size")).alias("name")).distinct()
    return profiles.unknown(have, [Spec("m", hmms=("dom1--dom51", "dom2"))], [Polyprotein([Peptide("p", ("dom49", "dom50--dom77"))])])


@query(f"""SELECT stratum, first_ord, n, row_number() OVER (ORDER BY first_ord, stratum) AS place FROM (SELECT n_name AS stratum, min(c_custkey) AS first_ord, count(*) AS n FROM {_NATIONS} GROUP BY 1)""")
def q_display_order(spark, sf_dir):
    people = _people(spark, sf_dir, F.repeat(F.md5("n_name"), 2)).withColumn("input_ord", F.col("id").cast("long"))
    clusters = select.global_threshold(people, 0.9, cluster.Config()).join(people.select(F.col("id").alias("member_id"), F.col("host").alias("h")), "member_id").drop("stratum").withColumnRenamed("h", "stratum")
    shown = select.display_order(clusters, people, "host").collect()  # one row for each nation
    return spark.createDataFrame([(*r, i + 1) for i, r in enumerate(shown)], "stratum string, first_ord long, n long, place long")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS k, 'a \"quoted\" ' || s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS even, CASE WHEN s_suppkey % 3 > 0 THEN ' x  y ' END AS blank FROM supplier")
def q_tsv_round_trip(spark, sf_dir):
    path, key = _folder(spark, "tsv"), F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(key.alias("k"), F.concat(F.lit('a "quoted" '), "s_name").alias("name"), (key % 2 == 0).alias("even"), F.when(key % 3 > 0, " x \t\ny ").otherwise("").alias("blank"))
    stores.write_tsv(rows, path)
    return stores.read_tsv(spark, path)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'isolate' ELSE 'sequence' END AS kind, CASE WHEN o_orderkey % 2 = 1 THEN 'a' || o_orderkey END AS accession,
CASE WHEN o_orderkey % 2 = 0 THEN 'L=l' || o_orderkey || ',S=s' || o_custkey END AS parts, md5(o_orderstatus) AS md5 FROM orders""")
def q_lock_entries(spark, sf_dir):
    key = _text("o_orderkey")
    part = lambda name, acc: F.struct(F.lit(name).alias("segment"), acc.alias("accession"))
    parts = F.array(part("S", F.lit("replaced")), part("L", F.concat(F.lit("l"), key)), part("S", F.concat(F.lit("s"), _text("o_custkey"))))
    reps = table(spark, sf_dir, "orders").select(key.alias("id"), F.concat(F.lit("a"), key).alias("accession"), F.col("o_orderstatus").alias("sequence"), F.when(F.col("o_orderkey") % 2 == 0, parts).alias("concat_segments"))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("segment_accessions")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return stores.representative_entries(reps).select("id", "kind", "accession", shown.alias("parts"), "md5")


@query("""WITH c AS (SELECT n_name, CAST(n_regionkey AS VARCHAR) AS r, (SELECT max(length(n_name)) FROM nation) AS w FROM nation)
SELECT 'n_name' || repeat(' ', CAST(max(w) - 6 AS INT)) || '  n_regionkey' AS value FROM c UNION ALL SELECT repeat('-', CAST(max(w) AS INT)) || '  -----------' FROM c
UNION ALL SELECT rpad(n_name, CAST(w AS INT), ' ') || '  ' || lpad(r, 11, ' ') FROM c""")
def q_text_table(spark, sf_dir):
    return reports.text_table(table(spark, sf_dir, "nation").select("n_name", "n_regionkey"), ["n_name"]).select("value")
