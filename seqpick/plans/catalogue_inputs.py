"""Further registered queries: headers, files, names and modes, each with SQL that builds the same rows from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import bind, cluster, cover, kmers, qc, reports, select
from ..schema import as_records
from ..sources import fasta, tables
from .catalogue import RECORDS, query, records, table


def _folder(spark, name: str) -> str:
    """A new folder below the one that driver and executors share."""
    cover.cut(spark.range(1))  # sets it where it is unset
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/seqpick-{name}-{uuid.uuid4().hex}"


def _nations(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


_NATIONS = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"

# --- headers ----------------------------------------------------------------------------------------


def _header(rows: DataFrame, header) -> DataFrame:
    return rows.select(F.col("c_custkey").alias("id"), fasta.header_fields(header).alias("f")).select("id", "f.*")


@query(f"""SELECT c_custkey AS id, 'uniprot' AS source, 'P' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS accession, lower(c_mktsegment) || ' protein 2' AS description, c_custkey % 2 = 0 AS is_reviewed, n_name || ' sp.' AS organism, CAST(c_custkey + 9 AS INT) AS taxid FROM {_NATIONS}""")
def q_uniprot_headers(spark, sf_dir):
    key = F.col("c_custkey")
    h = F.concat(F.when(key % 2 == 0, "sp|P").otherwise("tr|P"), F.lpad(key.cast("string"), 5, "0"), F.lit("|NAME_X "), F.lower("c_mktsegment"), F.lit(" protein 2 OS="), F.col("n_name"), F.lit(" sp. OX="), (key + 9).cast("string"), F.lit(" GN=abc PE=1 SV=2"))
    return _header(_nations(spark, sf_dir), h).select("id", "source", "accession", "description", "is_reviewed", "organism", "taxid")


@query(f"""SELECT c_custkey AS id, 'ncbi' AS source, 'AB' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '.1' AS accession, 'hypothetical ' || lower(c_mktsegment) AS description, false AS is_refseq, CASE WHEN c_custkey % 3 > 0 THEN n_name || ' virus' END AS organism FROM {_NATIONS}""")
def q_ncbi_headers(spark, sf_dir):
    tail = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit(" ["), F.col("n_name"), F.lit(" virus]"))).otherwise("")
    h = F.concat(F.lit("AB"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit(".1 hypothetical "), F.lower("c_mktsegment"), tail)
    return _header(_nations(spark, sf_dir), h).select("id", "source", "accession", "description", "is_refseq", "organism")


@query(f"""SELECT c_custkey AS id, 'ncbi_virus' AS source, 'NC_' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '.2' AS accession, true AS is_refseq, 'Alpha ' || lower(c_mktsegment) AS organism, upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) AS country, 'homo' AS host,
  (1990 + c_custkey % 30) || '-05' AS collection_date, CAST(c_custkey % 8 + 1 AS VARCHAR) AS segment, 'A/duck/' || c_custkey || '/1999' AS strain FROM {_NATIONS}""")
def q_virus_headers(spark, sf_dir):
    key = F.col("c_custkey")
    h = F.concat(
        F.lit("NC_"), F.lpad(key.cast("string"), 6, "0"), F.lit(".2 Some virus (A/duck/"), key.cast("string"), F.lit("/1999) segment "), (key % 8 + 1).cast("string"), F.lit(" gene ["), F.initcap("c_mktsegment"),
        F.lit("][homo]["), (1990 + key % 30).cast("string"), F.lit("-05][Alpha "), F.lower("c_mktsegment"), F.lit("]"))
    return _header(_nations(spark, sf_dir), h).select("id", "source", "accession", "is_refseq", "organism", "country", "host", "collection_date", "segment", "strain")


# --- files ------------------------------------------------------------------------------------------


@query("SELECT CAST(doc_id AS VARCHAR) AS id, md5(upper(regexp_replace(replace(replace(text, '>', ''), 'ß', 'ss'), '[ \\r\\n.*-]', '', 'g'))) AS body, doc_id % 2 AS file FROM documents")
def q_fasta_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    entry = fasta.fasta_lines(F.concat_ws(" ", F.col("doc_id").cast("string"), "source"), F.replace("text", F.lit(">"), F.lit("")))
    paths = [_folder(spark, f"fasta{i}") for i in (0, 1)]
    for i, p in enumerate(paths):
        docs.where(F.col("doc_id") % 2 == i).select(entry.alias("value")).write.text(p)
    got = fasta.read_fasta(spark, paths)
    # the file's place in the list leads the order
    return got.select("id", F.md5("sequence").alias("body"), F.shiftright("input_ord", 43).alias("file"))


@query("SELECT CAST(doc_id AS VARCHAR) AS accession, CAST(quality AS VARCHAR) AS quality, CASE WHEN toxic = 1 THEN 'yes' END AS toxic FROM labels")
def q_metadata_scan(spark, sf_dir):
    path = _folder(spark, "metadata")
    rows = table(spark, sf_dir, "labels").select(F.concat(F.lit(" "), F.col("doc_id").cast("string")).alias("accession"), F.col("quality").cast("string").alias("quality"), F.when(F.col("toxic") == 1, "yes ").otherwise(" ").alias("toxic"))
    # one file: the reader looks at its first line
    rows.coalesce(1).write.option("sep", "\t").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return tables.read_metadata(spark, path).drop("row_id")


@query("SELECT DISTINCT CAST(item_id * 2 AS VARCHAR) AS id FROM benchmark UNION SELECT * FROM (VALUES ('x1'), ('4'))")
def q_id_union(spark, sf_dir):
    path = _folder(spark, "ids")
    lines = table(spark, sf_dir, "benchmark").select(F.explode(F.array(F.lit("# a comment"), F.lit(""), F.concat(F.lit("  "), (F.col("item_id") * 2).cast("string")))).alias("value"))
    lines.write.text(path)
    return tables.union_ids(spark, ["x1", " 4 ", ""], [path])


@query("SELECT CAST(n_regionkey AS INT) AS cluster, 'n' || n_nationkey AS member, n_nationkey = (SELECT min(n_nationkey) FROM nation m WHERE m.n_regionkey = n.n_regionkey) AS is_rep FROM nation n")
def q_clstr_blocks(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    first = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("first"))
    mark = F.when(F.col("n_nationkey") == F.col("first"), "*").otherwise("at 97.5%")
    rows = n.join(first, "n_regionkey").select((F.col("n_regionkey") * 1000 + F.col("n_nationkey") + 1).alias("ord"), F.concat(F.lit("0\t120aa, >n"), F.col("n_nationkey").cast("string"), F.lit("... "), mark).alias("value"))
    heads = first.select((F.col("n_regionkey") * 1000).alias("ord"), F.concat(F.lit(">Cluster "), F.col("n_regionkey").cast("string")).alias("value"))
    return tables.parse_clstr(rows.unionByName(heads))


@query("""SELECT 'dom' || p_size AS target, 'q' || p_partkey AS query, CAST(p_size + 50 AS INT) AS hmm_len, 1e-5::DOUBLE AS dom_evalue, CAST(p_size AS INT) AS ali_from, CAST(p_size + 20 AS INT) AS ali_to, CAST(21 AS INT) AS ali_span FROM part WHERE p_partkey % 5 > 0""")
def q_domain_table(spark, sf_dir):
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    cell = lambda c: c.cast("string")
    line = F.concat_ws("  ", F.concat(F.lit("dom"), cell(size)), F.lit("-"), cell(size + 50), F.concat(F.lit("q"), cell(F.col("p_partkey"))), F.lit("-"), F.lit("300"), F.lit("1e-9"), F.lit("33.1"), F.lit("0.1"), F.lit("1"), F.lit("1"), F.lit("1e-6"), F.lit("1e-5"), F.lit("30.2"), F.lit("0.0"), F.lit("1"), F.lit("40"), cell(size), cell(size + 20), F.lit("1"), F.lit("50"), F.lit("0.9"), F.lit("a name"))
    lines = p.select(F.when(F.col("p_partkey") % 5 > 0, line).otherwise(F.concat(F.lit("# "), line)).alias("value"))
    return tables.parse_domtblout(lines).select("target", "query", "hmm_len", "dom_evalue", "ali_from", "ali_to", "ali_span")


# --- names ------------------------------------------------------------------------------------------


@query(r"""SELECT p_partkey AS id, coalesce(nullif(trim(regexp_replace(x, '[^A-Za-z0-9._-]+', '_', 'g'), '_'), ''), 'unnamed') AS path, replace(p_name, ' ', ' | ') AS line,
list_transform(regexp_extract_all(p_brand, '(\d+|\D+)', 1), lambda v: CASE WHEN regexp_matches(v, '^[0-9]') THEN lpad(v, 20, '0') ELSE lower(v) END) AS key
FROM (SELECT *, CASE WHEN p_partkey % 7 = 0 THEN ' ?? ' ELSE p_type || '/' || p_brand || ' (x)' END AS x FROM part)""")
def q_safe_names(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 7 == 0, " ?? ").otherwise(F.concat("p_type", F.lit("/"), "p_brand", F.lit(" (x)")))
    line = X.one_line(F.replace("p_name", F.lit(" "), F.lit(" |\t\r\n")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.path_safe(name).alias("path"), F.replace(line, F.lit("| "), F.lit("| ")).alias("line"), X.natural_key(F.col("p_brand")).alias("key"))


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'family' WHEN 1 THEN 'order' WHEN 2 THEN 'subfamily' WHEN 3 THEN 'genus' ELSE 'no rank' END AS rank, s_suppkey % 3 = 0 AS protein,
CAST(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 101 ELSE round_even((s_suppkey % 101) / 100.0 * 100, 0) END AS INT) AS support,
CASE WHEN s_suppkey % 11 = 0 THEN s_suppkey || ' ---' ELSE s_suppkey || ' ' || CAST(round_even(100.0 * s_suppkey / (s_suppkey % 11 * 100), 0) AS INT) || '%' END AS cell FROM supplier""")
def q_ranks_and_cells(spark, sf_dir):
    key = F.col("s_suppkey")
    name = F.element_at(F.array(*map(F.lit, ("Flaviviridae", "Picornavirales", "Orthoretrovirinae", "Lentivirus", "Some virus"))), (key % 5 + 1).cast("int"))
    accession = F.when(key % 3 == 0, F.concat(F.lit("YP_"), key.cast("string"))).otherwise(F.concat(F.lit("NC_"), key.cast("string")))
    support = F.when(key % 2 == 0, F.when(key % 101 == 1, 0.01).otherwise((key % 101).cast("double"))).otherwise((key % 101) / 100.0)
    return table(spark, sf_dir, "supplier").select(key.alias("id"), X.rank_from_name(name).alias("rank"), X.looks_like_protein_accession(accession).alias("protein"), X.support_percent(support).alias("support"), X.percent_cell(key, key % 11 * 100).alias("cell"))


@query("SELECT c_custkey AS id, 'a=' || CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE c_mktsegment END || ',b=' || c_mktsegment || ',c=' || n_name AS labels FROM customer JOIN nation ON c_nationkey = n_nationkey")
def q_label_merge(spark, sf_dir):
    old = F.create_map(F.lit("a"), F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")).otherwise(F.lit(None)), F.lit("c"), F.col("n_name"))
    new = F.create_map(F.lit("a"), F.col("c_mktsegment"), F.lit("b"), F.col("c_mktsegment"))
    got = F.array_sort(F.map_entries(bind.merge_labels(old, new, overwrite=False)))
    return _nations(spark, sf_dir).select(F.col("c_custkey").alias("id"), F.array_join(F.transform(got, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("labels"))


# --- modes ------------------------------------------------------------------------------------------


def _people(spark, sf_dir, body) -> DataFrame:
    key = F.col("c_custkey")
    taxonomy = F.from_json(F.to_json(F.struct(F.col("n_name").alias("genus"), F.create_map(F.lit("subfamily"), F.col("r_name")).alias("lineage"))), "genus string, lineage map<string,string>")
    rows = _nations(spark, sf_dir).select(key.cast("string").alias("id"), F.struct(*(F.lit(None).cast("string").alias(r) for r in ()), taxonomy["genus"].alias("genus"), taxonomy["lineage"].alias("lineage")).alias("t"), body.alias("sequence"), F.col("n_name").alias("host"), key.alias("input_ord"), F.col("c_mktsegment").alias("organism"))
    from ..schema import TAXONOMY

    return as_records(rows.withColumn("taxonomy", F.from_json(F.to_json("t"), TAXONOMY)).drop("t"))


@query(f"SELECT 'genus' AS rank, n_name AS taxon, count(*) AS n FROM {_NATIONS} GROUP BY ALL UNION ALL SELECT 'subfamily', r_name, count(*) FROM {_NATIONS} GROUP BY ALL UNION ALL SELECT 'class', 'Unknown', count(*) FROM {_NATIONS}")
def q_by_rank(spark, sf_dir):
    rows = _people(spark, sf_dir, F.lit("MK"))
    parts = [rows.groupBy(select.by_rank(r).alias("taxon")).agg(F.count("*").alias("n")).select(F.lit(r).alias("rank"), "taxon", "n") for r in ("genus", "subfamily", "class")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH c AS (SELECT c_custkey, n_name, r_name, min(c_custkey) OVER (PARTITION BY n_name) AS a FROM {_NATIONS}), r AS (SELECT *, min(a) OVER (PARTITION BY r_name) AS b FROM c)
SELECT CAST(b AS VARCHAR) AS rep_id, CAST(c_custkey AS VARCHAR) AS member_id FROM r""")
def q_nested_modes(spark, sf_dir):
    """All bodies are equal, so each level keeps the first record of each group, which stands for the others."""
    return select.nested(_people(spark, sf_dir, F.lit("MKLVAAGGTTSSPP")), [(select.by_host(), 1), (select.by_rank("subfamily"), 1)], cluster.Config())


@query(f"""SELECT CAST(min(c_custkey) OVER (PARTITION BY n_name) AS VARCHAR) AS rep_id, CAST(c_custkey AS VARCHAR) AS member_id, 0.9::DOUBLE AS cutoff FROM {_NATIONS}""")
def q_global_threshold(spark, sf_dir):
    """Equal bodies within a nation, and no common 5-mer between nations."""
    return select.global_threshold(_people(spark, sf_dir, F.repeat(F.md5("n_name"), 2)), 0.9, cluster.Config()).select("rep_id", "member_id", "cutoff")


@query(f"""WITH t AS (SELECT n_name || '/' || c_mktsegment AS taxon, count(*) AS n, count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 495000)) AS left_over FROM {_NATIONS} GROUP BY 1) SELECT 'genus' AS rank, taxon, n FROM t WHERE left_over = 0""")
def q_eliminated_pairs(spark, sf_dir):
    rows = _nations(spark, sf_dir)
    big = table(spark, sf_dir, "orders").where("o_totalprice > 495000").select(F.col("o_custkey").alias("c_custkey"))
    ranks = {"genus": F.concat_ws("/", "n_name", "c_mktsegment")}
    return reports.eliminated(reports.tally(rows, ranks), reports.tally(rows.join(big, "c_custkey", "left_semi"), ranks))


@query(f"SELECT value, n, 'length' AS stage FROM (SELECT 'g' || (CAST(id AS BIGINT) % 300) AS value, count(*) AS n, bool_and(length(sequence) < 1200) AS gone FROM ({RECORDS}) GROUP BY 1) WHERE gone")
def q_lost_small_labels(spark, sf_dir):
    rows = records(spark, sf_dir).withColumn("label", F.concat(F.lit("g"), (F.col("input_ord") % 300).cast("string")))
    return reports.lost_labels(rows, qc.length_bounds(rows, 1200, None).removed, "label")


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, embedding FROM embeddings),
pair AS MATERIALIZED (SELECT x.vec_id AS i, y.vec_id AS j, round(list_sum(list_transform(range(1, 65), lambda k: (CAST(x.embedding[k] AS DOUBLE) - CAST(y.embedding[k] AS DOUBLE)) ** 2)), 4) AS d FROM e x, e y),
walk AS (SELECT 1 AS pick, [(SELECT min(vec_id) FROM e)] AS got UNION ALL
  SELECT pick + 1, list_append(got, (SELECT i FROM (SELECT i, min(d) AS d FROM pair WHERE list_contains(got, j) AND NOT list_contains(got, i) GROUP BY i) ORDER BY d DESC, i LIMIT 1)) FROM walk WHERE pick < 5)
SELECT got[pick] AS vec_id, CAST(pick AS INT) AS pick FROM walk""")
def q_maxmin(spark, sf_dir):
    pool = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")

    def distance(row):
        target = F.array(*(F.lit(float(x)) for x in row["embedding"]))
        return F.round(F.aggregate(F.zip_with("embedding", target, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x), 4)

    return kmers.farthest_first(pool, 5, "vec_id", distance, (F.col("vec_id").asc(),))
