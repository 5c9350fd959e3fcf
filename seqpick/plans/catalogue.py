"""Registered queries over the driver's tables, each with the SQL of the same result where SQL can tell it.

Documents stand for records (text: body, source: host, lang: organism), labels for a metadata table that covers part of them,
benchmark for an id list, conversations for records in parts, customers with nation and region for records with a lineage,
orders for dated records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as X
from ..operators import bind, cluster, isolates, kmers, markers, qc, reports, select, trees
from ..schema import as_records, filled
from ..sources.fasta import header_fields
from ..streaming import windows

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def put(f):
        _QUERIES[f.__name__] = (f, sql)
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalogue_inputs, catalogue_reports  # noqa: F401  they register their own

    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {k: s for k, (_, s) in _QUERIES.items() if s}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records; a label of good quality makes one a reference record, a toxic one reviewed."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    text = F.col("text")
    return docs.select(
        F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("accession"), F.concat_ws(" ", F.col("doc_id").cast("string"), "source", "lang").alias("header"),
        text.alias("sequence"), X.seq_type(text).alias("seq_type"), F.col("lang").alias("organism"), text.alias("description"), F.col("source").alias("host"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("is_refseq"), (F.coalesce("toxic", F.lit(0)) == 1).alias("is_reviewed"), F.col("doc_id").alias("input_ord"),
    )


RECORDS = """SELECT CAST(d.doc_id AS VARCHAR) AS id, d.text AS sequence, d.source AS host, d.lang AS organism, coalesce(quality, 0) = 1 AS is_refseq,
  coalesce(toxic, 0) = 1 AS is_reviewed, d.doc_id AS input_ord
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id)"""
BEST = f"""SELECT *, row_number() OVER (PARTITION BY md5(sequence) ORDER BY is_refseq DESC, is_reviewed DESC, input_ord) AS nth,
  first_value(id) OVER (PARTITION BY md5(sequence) ORDER BY is_refseq DESC, is_reviewed DESC, input_ord) AS best FROM ({RECORDS})"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, stratify, elect: the three best records of each source, and what was cleaned away before."""
    return q_representatives(spark, sf_dir)


# --- cleaning ---------------------------------------------------------------------------------------


@query(f"""WITH k AS (SELECT * FROM ({BEST}) WHERE nth = 1 AND length(sequence) BETWEEN 200 AND 20000)
SELECT host AS stratum, id, place, n_chars FROM (SELECT host, id, length(sequence) AS n_chars,
  row_number() OVER (PARTITION BY host ORDER BY is_refseq DESC, is_reviewed DESC, length(sequence) DESC, input_ord) AS place FROM k) WHERE place <= 3""")
def q_representatives(spark, sf_dir):
    kept = qc.length_bounds(qc.exact_duplicates(records(spark, sf_dir)).kept, 200, 20000).kept
    return select.elect(kept, ["host"], 3).select(F.col("host").alias("stratum"), "id", F.col("place").cast("bigint"), F.length("sequence").cast("bigint").alias("n_chars"))


@query(f"SELECT id, is_refseq, is_reviewed FROM ({BEST}) WHERE nth = 1")
def q_exact_dedup_keep_best(spark, sf_dir):
    return qc.exact_duplicates(records(spark, sf_dir)).kept.select("id", "is_refseq", "is_reviewed")


@query(f"SELECT id, 'duplicates' AS stage, 'exact_duplicate_of:' || best AS reason FROM ({BEST}) WHERE nth > 1")
def q_dup_reason_log(spark, sf_dir):
    return qc.exact_duplicates(records(spark, sf_dir)).removed


@query(f"""SELECT id, 'length' AS stage, CASE WHEN length(sequence) < 500 THEN 'length_too_short:' ELSE 'length_too_long:' END || length(sequence) AS reason
FROM ({RECORDS}) WHERE length(sequence) < 500 OR length(sequence) > 15000""")
def q_length_bounds(spark, sf_dir):
    return qc.length_bounds(records(spark, sf_dir), 500, 15000).removed


@query(f"""SELECT id, round(f, 6) AS share, f > 0.25 AS fails FROM
(SELECT id, CASE WHEN length(sequence) = 0 THEN 0.0 ELSE length(regexp_replace(lower(sequence), '[^xbzj]', '', 'g')) / length(sequence) END AS f FROM ({RECORDS}))""")
def q_ambiguity_fraction(spark, sf_dir):
    share = X.ambiguity(F.col("sequence"), "protein")
    return records(spark, sf_dir).select("id", F.round(share, 6).alias("share"), (share > 0.25).alias("fails"))


@query(f"SELECT id, lower(k) AS keyword FROM (SELECT id, regexp_extract(sequence, '(?i)(\\btoken\\b|\\bidiot\\b|\\bworthless\\b)', 1) AS k FROM ({RECORDS})) WHERE k <> ''")
def q_keyword_filter(spark, sf_dir):
    hit = X.keyword_hit(F.col("description"), F.col("header"), ("token", "idiot", "worthless"))
    return records(spark, sf_dir).select("id", F.lower(hit).alias("keyword")).where("keyword is not null")


@query(f"""SELECT organism, CASE WHEN s = '' THEN 'unknown' WHEN regexp_matches(s, '[EFILPQZefilpqz]') THEN 'protein'
  WHEN length(regexp_replace(s, '[Nn]', '', 'g')) = 0 THEN 'nucleotide'
  WHEN length(regexp_replace(s, '[^ACGTUacgtu]', '', 'g')) / length(regexp_replace(s, '[Nn]', '', 'g')) >= 0.9 THEN 'nucleotide' ELSE 'protein' END AS seq_type, count(*) AS n
FROM (SELECT organism, sequence AS s FROM ({RECORDS})) GROUP BY ALL""")
def q_seq_type_infer(spark, sf_dir):
    return records(spark, sf_dir).groupBy("organism", "seq_type").agg(F.count("*").alias("n"))


_FUNNEL = f"""WITH d AS ({BEST}), a AS (SELECT * FROM d WHERE nth = 1), b AS (SELECT * FROM a WHERE length(sequence) BETWEEN 200 AND 10000),
c AS (SELECT *, regexp_extract(sequence, '(?i)(\\btoken\\b|\\bidiot\\b)', 1) AS k FROM b), log AS (
SELECT 'duplicates' AS stage, 'exact_duplicate_of' AS reason FROM d WHERE nth > 1
UNION ALL SELECT 'length', CASE WHEN length(sequence) < 200 THEN 'length_too_short' ELSE 'length_too_long' END FROM a WHERE length(sequence) NOT BETWEEN 200 AND 10000
UNION ALL SELECT 'annotation', 'annotation_keyword' FROM c WHERE k <> '')"""
_BASIC = {"min_length": 200, "max_length": 10000, "ambiguous_threshold": 1.0, "keywords": ["token", "idiot"]}


@query(f"{_FUNNEL} SELECT stage, reason, count(*) AS n FROM log GROUP BY ALL")
def q_qc_funnel(spark, sf_dir):
    return qc.counters(qc.run_basic(records(spark, sf_dir), _BASIC).removed)


@query(f"""{_FUNNEL}, n AS (SELECT stage, count(*) AS removed, list_position(['duplicates', 'length', 'ambiguous', 'annotation'], stage) AS p FROM log GROUP BY stage)
SELECT stage, removed, (SELECT count(*) FROM documents) - CAST(sum(removed) OVER (ORDER BY p) AS BIGINT) AS survivors FROM n""")
def q_running_survivors(spark, sf_dir):
    rows = records(spark, sf_dir)
    return qc.running_survivors(rows.count(), qc.counters(qc.run_basic(rows, _BASIC).removed), list(qc.STAGES[:4]))


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)")
def q_blocklist_anti(spark, sf_dir):
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"))
    return qc.blocklist(records(spark, sf_dir), ids)[0].select("id")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey IN (SELECT doc_id FROM documents) THEN 'excluded' ELSE 'unavailable' END AS action FROM customer")
def q_unavailable_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    return qc.blocklist(records(spark, sf_dir), ids)[1]


@query(f"""SELECT CASE WHEN id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1) THEN 'protected' ELSE 'removed' END AS log, id, 'length_too_short:' || length(sequence) AS reason
FROM ({RECORDS}) WHERE length(sequence) < 800""")
def q_protected_keep(spark, sf_dir):
    protect = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("id"))
    got = qc.length_bounds(records(spark, sf_dir), 800, None, protect)
    return got.removed.select(F.lit("removed").alias("log"), "id", "reason").unionByName(got.protected.select(F.lit("protected").alias("log"), "id", "reason"))


# --- identifiers and joins --------------------------------------------------------------------------

_NORM = "nullif(regexp_replace(trim(replace(regexp_replace(lower(trim(x)), '\\s+', '_', 'g'), '|', '_'), '_'), '\\.[0-9]+$', ''), '')"


@query(f"SELECT x AS name, {_NORM} AS key FROM (SELECT c_name || '.1' AS x FROM customer UNION ALL SELECT ' ' || s_name || '|' FROM supplier UNION ALL SELECT p_name || ' ' || p_brand FROM part)")
def q_norm_id(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat("c_name", F.lit(".1")).alias("name"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit(" "), "s_name", F.lit("|")).alias("name"))
    p = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    return c.unionByName(s).unionByName(p).select("name", X.match_key(F.col("name")).alias("key"))


@query("""SELECT CAST(d.doc_id AS VARCHAR) AS id, coalesce(CASE WHEN min(quality) <> max(quality) THEN 'Conflict' ELSE CAST(min(quality) AS VARCHAR) END, 'Unknown') AS value,
  CASE WHEN min(quality) <> max(quality) THEN 'conflict' WHEN min(quality) IS NULL THEN 'none' ELSE 'table:accession' END AS matched_by
FROM documents d LEFT JOIN labels USING (doc_id) GROUP BY d.doc_id""")
def q_table_bind(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit(".2")).alias("accession"), F.col("quality").cast("string").alias("quality_label"), F.monotonically_increasing_id().alias("row_id"))
    rows = bind.resolve_field(records(spark, sf_dir), "quality_label", labels)
    return rows.select("id", "group.value", "group.matched_by")


@query("SELECT l_orderkey AS id, CASE WHEN min(l_returnflag) <> max(l_returnflag) THEN 'Conflict' ELSE min(l_returnflag) END AS label FROM lineitem GROUP BY 1")
def q_label_conflict(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(stats.resolve(F.col("l_returnflag")).alias("label"))


@query("""SELECT c_custkey AS id, coalesce(nullif(trim(n_name), ''), 'Unknown') AS country, CASE WHEN c_acctbal > 0 THEN 'own' ELSE r_name END AS place
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def q_enrich_coalesce(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", F.lit("Unknown").alias("country"), F.when(F.col("c_acctbal") > 0, "own").otherwise("").alias("place"))
    dim = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"), F.col("r_name").alias("place"))
    out = bind.enrich(c, dim.select("c_nationkey", "country"), "c_nationkey", ["country"])
    return bind.enrich(out, dim.select("c_nationkey", "place"), "c_nationkey", ["place"], override=False).select("id", "country", "place")


@query("SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'assistant' AND trim(text) <> '') AS text FROM conversations GROUP BY conv_id")
def q_first_non_empty(spark, sf_dir):
    t = F.when(F.col("role") == "assistant", filled(F.col("text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min(F.when(t.isNotNull(), F.struct("turn", t.alias("text"))))["text"].alias("text"))


@query("""
WITH c AS (SELECT label, min(vec_id) AS vec FROM embeddings GROUP BY label), p AS (
  SELECT e.vec_id AS query, c.vec AS target, round(list_sum(list_transform(range(1, 65), lambda i: (CAST(e.embedding[i] AS DOUBLE) - CAST(t.embedding[i] AS DOUBLE)) * (CAST(e.embedding[i] AS DOUBLE) - CAST(t.embedding[i] AS DOUBLE)))), 4) AS d
  FROM embeddings e, c JOIN embeddings t ON t.vec_id = c.vec)
SELECT query, target, d FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, target) AS k FROM p) WHERE k = 1""")
def q_nearest_target(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min("vec_id").alias("target")).join(e.select(F.col("vec_id").alias("target"), F.col("embedding").alias("t")), "target").select("target", F.col("target").alias("ord"), "t")
    wide = F.aggregate(F.zip_with("q", "t", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return bind.nearest(e.select(F.col("vec_id").alias("query"), F.col("embedding").alias("q")), first, F.round(wide, 4)).select("query", "target", "d")


# --- reports ----------------------------------------------------------------------------------------


def _customers(spark, sf_dir) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")


_RANKS = {"genus": "c_mktsegment", "family": "n_name", "order": "r_name"}
_CUSTOMERS = "customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"
_TALLY = "".join(f"{' UNION ALL ' if i else ''}SELECT '{r}' AS rank, {c} AS taxon, count(*) AS n FROM {{rows}} WHERE {c} IS NOT NULL GROUP BY {c}" for i, (r, c) in enumerate(_RANKS.items()))


def _ranks() -> dict[str, Column]:
    return {r: F.col(c) for r, c in _RANKS.items()}


@query(_TALLY.format(rows=_CUSTOMERS))
def q_rank_tally(spark, sf_dir):
    return reports.tally(_customers(spark, sf_dir), _ranks())


@query(f"SELECT 'taxa' AS report, rank, 'pool' AS pool, '*ALL*' AS taxon, CAST(sum(n) AS BIGINT) AS taxon_count, CAST(NULL AS VARCHAR) AS spec, 'n_taxa' AS metric, CAST(count(*) AS DOUBLE) AS value FROM ({_TALLY.format(rows=_CUSTOMERS)}) GROUP BY rank")
def q_tidy_report(spark, sf_dir):
    d = reports.distinct_taxa(reports.tally(_customers(spark, sf_dir), _ranks())).withColumns({"pool": F.lit("pool"), "all": F.lit("*ALL*")})
    return reports.tidy("taxa", d, ["n_taxa"], rank="rank", pool="pool", taxon="all", count="n")


_RICH = f"(SELECT * FROM {_CUSTOMERS} WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000))"


def _rich(spark, sf_dir) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return _customers(spark, sf_dir).join(big, "c_custkey", "left_semi")


@query(f"WITH b AS ({_TALLY.format(rows=_CUSTOMERS)}), a AS ({_TALLY.format(rows=_RICH)}) SELECT rank, taxon, n FROM b WHERE rank <> 'species' AND NOT EXISTS (SELECT 1 FROM a WHERE a.rank = b.rank AND a.taxon = b.taxon)")
def q_eliminated_taxa(spark, sf_dir):
    return reports.eliminated(reports.tally(_customers(spark, sf_dir), _ranks()), reports.tally(_rich(spark, sf_dir), _ranks()))


@query(f"""WITH b AS ({_TALLY.format(rows=_CUSTOMERS)}), a AS ({_TALLY.format(rows=_RICH)}), j AS (SELECT b.rank, b.taxon, b.n, coalesce(a.n, 0) AS n_after,
row_number() OVER (PARTITION BY b.rank ORDER BY b.n DESC, b.taxon) AS place FROM b LEFT JOIN a USING (rank, taxon)) SELECT rank, taxon, n, n_after, place FROM j WHERE place <= 5 OR n_after = 0""")
def q_topk_never_truncate(spark, sf_dir):
    got = reports.top_or_eliminated(reports.tally(_customers(spark, sf_dir), _ranks()), reports.tally(_rich(spark, sf_dir), _ranks()), 5)
    return got.select("rank", "taxon", "n", "n_after", F.col("place").cast("bigint"))


@query("""WITH c AS (SELECT source, lang, count(*) AS c FROM documents GROUP BY 1, 2), p AS (SELECT source, max(c) / sum(c) AS purity, count(*) AS n_distinct FROM c GROUP BY 1)
SELECT source AS cluster, count(*) AS size, min(length(text)) AS min_length, max(length(text)) AS max_length, CAST(round_even(median(length(text)), 0) AS BIGINT) AS median_length, round(any_value(purity), 6) AS purity, any_value(n_distinct) AS n_distinct
FROM documents JOIN p USING (source) GROUP BY source""")
def q_cluster_purity(spark, sf_dir):
    got = reports.purity(table(spark, sf_dir, "documents"), "source", F.col("lang"), F.length("text").cast("bigint"))
    return got.withColumn("purity", F.round("purity", 6))


_EXCL = "s[greatest(1, least(n - 1, CAST(floor({p} * (n + 1)) AS INT)))] * (1 - ({p} * (n + 1) - greatest(1, least(n - 1, CAST(floor({p} * (n + 1)) AS INT))))) + s[greatest(1, least(n - 1, CAST(floor({p} * (n + 1)) AS INT))) + 1] * ({p} * (n + 1) - greatest(1, least(n - 1, CAST(floor({p} * (n + 1)) AS INT))))"


@query(f"""SELECT taxon, s[1] AS min, s[n] AS max, CAST(round_even(m, 0) AS BIGINT) AS median, CASE WHEN n > 1 THEN CAST(round_even(({_EXCL.format(p=0.75)}) - ({_EXCL.format(p=0.25)}), 0) AS BIGINT) ELSE 0 END AS iqr, n
FROM (SELECT source AS taxon, list_sort(list(length(text))) AS s, median(length(text)) AS m, count(*) AS n FROM documents GROUP BY 1)""")
def q_quartiles_exclusive(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("taxon"), F.length("text").alias("len"))
    return reports.length_summary(rows, ["taxon"], "len")


@query("""SELECT lang AS taxon, spec, count(*) AS n, count(*) FILTER (WHERE has) AS covered FROM (
SELECT lang, unnest([{'spec': 'labelled', 'has': l.doc_id IS NOT NULL}, {'spec': 'toxic', 'has': coalesce(toxic, 0) = 1}, {'spec': 'long', 'has': length(text) > 2000}], recursive := true)
FROM documents LEFT JOIN labels l USING (doc_id)) GROUP BY ALL""")
def q_coverage_per_taxon(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").withColumn("has_label", F.lit(True)), "doc_id", "left")
    return reports.coverage(rows, F.col("lang"), {"labelled": F.col("has_label"), "toxic": F.col("toxic") == 1, "long": F.length("text") > 2000})


@query("""WITH r AS (SELECT CAST(turn AS VARCHAR) AS taxon, role, conv_id, length(text) AS len FROM conversations), w AS (SELECT taxon, round(avg(len) FILTER (WHERE role = 'user'), 6) AS "user",
round(avg(len) FILTER (WHERE role = 'assistant'), 6) AS assistant FROM r GROUP BY 1), t AS (SELECT taxon, round(avg(len), 6) AS total FROM (SELECT taxon, conv_id, sum(len) AS len FROM r GROUP BY 1, 2) GROUP BY 1) SELECT * FROM w JOIN t USING (taxon)""")
def q_length_pivot_total(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("taxon", F.col("turn").cast("string"))
    got = reports.length_pivot(rows, "taxon", "role", "conv_id", F.length("text"), ["user", "assistant"])
    return got.select("taxon", *(F.round(c, 6).alias(c) for c in ("user", "assistant", "total")))


@query("""WITH per AS (SELECT o_orderpriority AS taxon, o_orderstatus AS spec, CAST(year(o_orderdate) AS VARCHAR) AS peptide, count(*) FILTER (WHERE o_totalprice > 450000) AS c, count(*) AS n FROM orders GROUP BY 1, 2, 3),
s AS (SELECT taxon, spec, count(*) AS peptides, count(*) FILTER (WHERE c > 0) AS covered, max(n) AS n FROM per GROUP BY 1, 2), h AS (SELECT *, row_number() OVER (PARTITION BY taxon ORDER BY covered DESC, peptides DESC, spec) AS p FROM s)
SELECT taxon, spec AS home, peptides, covered, peptides - covered AS zeros, n, n >= 3 AND (covered = 0 OR (peptides - covered) / peptides >= 0.6) AS alarm FROM h WHERE p = 1""")
def q_walls(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("peptide", F.year("o_orderdate").cast("string"))
    return reports.walls(rows, "o_orderpriority", "o_orderstatus", F.col("o_totalprice") > 450000)


@query("""SELECT field, filled, n, filled / n AS share FROM (SELECT count(*) AS n, unnest([{'field': 'lang', 'filled': count(nullif(trim(lang), ''))}, {'field': 'source', 'filled': count(nullif(trim(source), ''))}, {'field': 'quality', 'filled': count(quality)}], recursive := true)
FROM documents LEFT JOIN labels USING (doc_id))""")
def q_input_profile(spark, sf_dir):
    return reports.profile(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left"), ["lang", "source", "quality"])


@query(f"""WITH a AS (SELECT organism AS value, count(*) AS n_pre FROM ({RECORDS}) GROUP BY 1), b AS (SELECT organism AS value, count(*) AS n_pool FROM ({BEST}) WHERE nth = 1 GROUP BY 1),
c AS (SELECT organism AS value, count(*) AS n_reps FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY is_refseq DESC, is_reviewed DESC, length(sequence) DESC, input_ord) AS k FROM ({BEST}) WHERE nth = 1) WHERE k <= 2 GROUP BY 1)
SELECT value, n_pre, coalesce(n_pool, 0) AS n_pool, coalesce(n_reps, 0) AS n_reps, n_pre AS n_pre_shown FROM a LEFT JOIN b USING (value) LEFT JOIN c USING (value)""")
def q_label_table_3stage(spark, sf_dir):
    rows = records(spark, sf_dir)
    pool = qc.exact_duplicates(rows).kept
    return reports.label_table(rows, pool, select.elect(pool, ["host"], 2), "organism")


@query(f"""WITH g AS (SELECT organism AS value, id, length(sequence) < 500 AS gone FROM ({RECORDS})) SELECT value, count(*) AS n, 'length' AS stage FROM g GROUP BY value HAVING bool_and(gone)
UNION ALL SELECT value, n, 'length' FROM (SELECT host || '/' || organism AS value, count(*) AS n, bool_and(length(sequence) < 500) AS gone FROM ({RECORDS}) GROUP BY 1) WHERE gone""")
def q_lost_labels(spark, sf_dir):
    rows = records(spark, sf_dir)
    log = qc.length_bounds(rows, 500, None).removed
    pair = rows.withColumn("both", F.concat_ws("/", "host", "organism"))
    return reports.lost_labels(rows, log, "organism").unionByName(reports.lost_labels(pair, log, "both"))


@query("""SELECT subtype, n_before, n_after, round(n_after / sum(n_after) OVER (), 6) AS share FROM (SELECT nullif(lower(event_type), 'none') AS subtype, count(*) AS n_before, count(*) FILTER (WHERE value > 50) AS n_after FROM events GROUP BY 1)""")
def q_subtype_shares(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("subtype", F.lower("event_type"))
    got = reports.subtype_shares(e, e.where("value > 50"))
    return got.withColumn("share", F.round("share", 6))


# --- groups and representatives ---------------------------------------------------------------------


@query("""SELECT country, id, place FROM (SELECT n_name AS country, c_custkey AS id, row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey) WHERE place <= 3""")
def q_by_country_topn(spark, sf_dir):
    rows = _customers(spark, sf_dir).withColumn("country", F.concat_ws(": ", "n_name", "c_mktsegment"))
    w = Window.partitionBy(select.by_country()).orderBy(F.desc("c_acctbal"), "c_custkey")
    return rows.select(select.by_country().alias("country"), F.col("c_custkey").alias("id"), F.row_number().over(w).cast("bigint").alias("place")).where("place <= 3")


def _dated(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("collection_date"), F.lit(None).cast("string").alias("strain"), F.col("o_totalprice").alias("price"))


def _by_time(window):
    def run(spark, sf_dir):
        return _dated(spark, sf_dir).groupBy(select.by_time(window).alias("stratum")).agg(F.count("*").alias("n"), F.round(F.max("price"), 6).alias("top"))

    return run


for _name, _window, _label in (("year", "year", "CAST(y AS VARCHAR)"), ("decade", "decade", "(y // 10 * 10) || 's'"), ("bin5", 5, "(y // 5 * 5) || '-' || (y // 5 * 5 + 4)")):
    _QUERIES[f"q_by_time_{_name}"] = (_by_time(_window), f"SELECT {_label} AS stratum, count(*) AS n, round(max(p), 6) AS top FROM (SELECT year(o_orderdate) AS y, o_totalprice AS p FROM orders) GROUP BY 1")


@query("SELECT 'host=' || source || '|organism=' || lang AS stratum, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def q_hybrid_grid(spark, sf_dir):
    key = select.by_fields({"host": select.by_host(), "organism": F.coalesce(filled(F.col("organism")), F.lit("Unknown"))})
    return records(spark, sf_dir).groupBy(key.alias("stratum")).agg(F.count("*").alias("n"), F.min("input_ord").alias("first"))


@query("""SELECT matched_by, value, count(*) AS n FROM (SELECT CASE WHEN quality IS NOT NULL THEN 'table:accession' WHEN source <> 'src0' THEN 'header_regex' ELSE 'none' END AS matched_by,
CASE WHEN quality IS NOT NULL THEN 'q' || quality WHEN source <> 'src0' THEN regexp_extract(source, 'src([1-9][0-9]*)', 1) ELSE 'Unknown' END AS value FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY ALL""")
def q_field_provenance(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("accession"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("clade"), F.monotonically_increasing_id().alias("row_id"))
    rows = bind.resolve_field(records(spark, sf_dir), "clade", labels, r"src(?P<value>[1-9][0-9]*)")
    return rows.groupBy("group.matched_by", "group.value").agg(F.count("*").alias("n"))


@query(f"SELECT organism, id FROM (SELECT organism, id, row_number() OVER (PARTITION BY organism ORDER BY length(sequence) DESC, is_reviewed DESC, input_ord) AS k FROM ({RECORDS})) WHERE k = 1")
def q_elect_priority(spark, sf_dir):
    return select.elect(records(spark, sf_dir), ["organism"], 1, ("longest", "reviewed_uniprot")).select("organism", "id")


@query(f"""WITH r AS (SELECT *, id IN (SELECT CAST(item_id * 3 AS VARCHAR) FROM benchmark) AS pinned, row_number() OVER (PARTITION BY host ORDER BY is_refseq DESC, is_reviewed DESC, length(sequence) DESC, input_ord) AS k FROM ({RECORDS})),
s AS (SELECT *, k = 1 AS is_rep, bool_or(k = 1 AND pinned) OVER (PARTITION BY host) AS rp, CASE WHEN pinned AND k > 1 THEN row_number() OVER (PARTITION BY host, pinned, k = 1 ORDER BY k) END AS nth FROM r)
SELECT id, CASE WHEN is_rep THEN 'already_representative' WHEN nth = 1 AND NOT rp THEN 'elected_representative' ELSE 'split_singleton' END AS action FROM s WHERE pinned
UNION ALL SELECT CAST(item_id * 3 AS VARCHAR), 'unavailable' FROM benchmark WHERE item_id * 3 NOT IN (SELECT doc_id FROM documents)""")
def q_force_select(spark, sf_dir):
    rows = records(spark, sf_dir)
    w = Window.partitionBy("host").orderBy(*select.priority())
    members = rows.select(F.col("host").alias("cluster_id"), F.col("id").alias("member_id"), (F.row_number().over(w) == 1).alias("is_rep"))
    pins = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 3).cast("string").alias("id"))
    return select.force_select(members, rows, pins)[1]


@query("""WITH u AS (SELECT *, row_number() OVER (ORDER BY d) AS k FROM (SELECT source || '/' || lang AS g, min(doc_id) AS d FROM documents GROUP BY 1))
SELECT doc_id AS id FROM (SELECT doc_id, source, lang FROM documents) d JOIN u ON u.d = doc_id UNION ALL
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS k FROM documents WHERE doc_id NOT IN (SELECT d FROM u)) WHERE k <= greatest(0, 200 - (SELECT count(*) FROM u))""")
def q_subsample_keep_reps(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    first = docs.groupBy("source", "lang").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("rep"))
    rows = docs.join(first, "doc_id", "left").withColumn("rep", F.coalesce("rep", F.lit(False)))
    return select.subsample(rows, F.col("rep"), 200, "doc_id").select(F.col("doc_id").alias("id"))


# --- clustering -------------------------------------------------------------------------------------

_CLUSTER = cluster.Config(protein=True, overflow="trim")


@query()
def q_threshold_search(spark, sf_dir):
    got = select.stratified(records(spark, sf_dir), select.by_host(), 5, _CLUSTER)
    return got.select("stratum", "rep_id", "member_id", "is_rep", F.round("cutoff", 6).alias("cutoff"), "trimmed_from")


@query()
def q_threshold_cluster(spark, sf_dir):
    keep = cluster.Config(protein=True, overflow="keep", backend="greedy")
    return select.stratified(records(spark, sf_dir), select.by_fields({"host": select.by_host(), "organism": F.col("organism")}), 2, keep).select("stratum", "rep_id", "member_id", "is_rep")


@query()
def q_diversity_curve(spark, sf_dir):
    return select.diversity_curve(records(spark, sf_dir), select.by_host(), _CLUSTER)


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, doc_id) AS k FROM documents), b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS m FROM a WHERE k <= 40)
SELECT lang, source, CAST(doc_id AS VARCHAR) AS id FROM b WHERE m <= 2""")
def q_nested_ranks(spark, sf_dir):
    rows = records(spark, sf_dir)
    coarse = select.elect(rows, ["organism"], 40, ("longest",)).drop("place")
    return select.elect(coarse, ["host"], 2, ("longest",)).select(F.col("organism").alias("lang"), F.col("host").alias("source"), "id")


@query("SELECT doc_id AS id, CAST(len(list_distinct(list_transform(range(1, greatest(length(t) - 3, 1)), lambda i: t[i:i + 4]))) AS BIGINT) AS n FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def q_kmer_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), kmers.kmer_count(F.col("text"), 5).alias("n"))


@query("""WITH w AS (SELECT doc_id, source, list_distinct(string_split(text, ' ')) AS w, length(text) AS n FROM documents), r AS (SELECT source, arg_min(w, (-n, doc_id)) AS rep FROM w GROUP BY 1)
SELECT doc_id AS id, round(1 - len(list_intersect(w, rep)) / (len(w) + len(rep) - len(list_intersect(w, rep))), 6) AS jaccard, round(1 - len(list_intersect(w, rep)) / least(len(w), len(rep)), 6) AS containment FROM w JOIN r USING (source)""")
def q_rep_distance(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.array_distinct(F.split("text", " ")).alias("members"), F.length("text").alias("n"))
    first = words.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("n"), "id")).alias("f")).select("source", "f.id")
    reps = words.join(first, ["source", "id"], "left_semi").select("source", "members")
    got = kmers.distances_to_representative(words, reps, "source")
    return got.select("id", F.round("jaccard", 6).alias("jaccard"), F.round("containment", 6).alias("containment"))


# --- records in parts -------------------------------------------------------------------------------

_VIRUS = {"segments": ["user", "assistant"], "isolate_regex": None}


def _turns(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    return as_records(t.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.concat(F.lit("Conv "), F.col("conv_id").cast("string")).alias("isolate_id"), F.col("role").alias("segment"), F.col("text").alias("sequence"), (F.col("conv_id") * 10000 + F.col("turn")).alias("input_ord")))


_PARTS = "SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY length(text) DESC, turn) AS nth FROM conversations"


@query(f"""WITH p AS (SELECT * FROM ({_PARTS}) WHERE nth = 1), g AS (SELECT conv_id, list_sort(list_distinct(list(role))) AS have FROM p GROUP BY 1)
SELECT conv_id || '-' || turn AS id, CASE WHEN len(list_filter(have, lambda x: x NOT IN ('user', 'assistant'))) > 0 THEN 'extra_segments:' || array_to_string(list_filter(have, lambda x: x NOT IN ('user', 'assistant')), ',')
ELSE 'incomplete_isolate:missing_segments:' || array_to_string(list_filter(['assistant', 'user'], lambda x: NOT list_contains(have, x)), ',') END AS reason
FROM p JOIN g USING (conv_id) WHERE NOT (list_contains(have, 'user') AND list_contains(have, 'assistant')) OR len(list_filter(have, lambda x: x NOT IN ('user', 'assistant'))) > 0""")
def q_isolate_complete(spark, sf_dir):
    stage, _ = isolates.complete(_turns(spark, sf_dir), _VIRUS, "drop")
    return stage.removed.select("id", "reason")


@query(f"""WITH p AS (SELECT * FROM ({_PARTS}) WHERE nth = 1 AND role IN ('user', 'assistant')), g AS (SELECT conv_id FROM p GROUP BY 1 HAVING count(*) = 2)
SELECT 'CONCAT|conv_' || conv_id AS id, md5(string_agg(text, '' ORDER BY CASE role WHEN 'user' THEN 1 ELSE 2 END)) AS body, CAST(count(*) AS INT) AS parts FROM p JOIN g USING (conv_id) GROUP BY conv_id""")
def q_isolate_concat(spark, sf_dir):
    stage, _ = isolates.complete(_turns(spark, sf_dir), _VIRUS)
    return isolates.assemble(stage.kept).select("id", F.md5("sequence").alias("body"), F.size("concat_segments").alias("parts"))


@query(f"SELECT 'conv_' || conv_id AS isolate_key, role AS segment, conv_id || '-' || turn AS id FROM ({_PARTS}) WHERE nth = 1")
def q_dup_segment_longest(spark, sf_dir):
    rows = _turns(spark, sf_dir).withColumn("isolate_key", X.norm_id(F.col("isolate_id")))
    return isolates.best_parts(rows).select("isolate_key", "segment", "id")


@query("SELECT CAST(l_suppkey AS VARCHAR) AS isolate_id, l_returnflag AS segment, list_sort(list_distinct(list(CAST(l_linenumber AS VARCHAR)))) AS accessions FROM lineitem WHERE l_quantity > 25 GROUP BY 1, 2 HAVING count(DISTINCT l_linenumber) > 1")
def q_strain_collision(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_suppkey").cast("string").alias("isolate_id"), F.lit("strain").alias("isolate_id_source"), F.col("l_returnflag").alias("segment"), F.col("l_linenumber").cast("string").alias("accession"), F.lit(None).cast("string").alias("id"))
    return isolates.strain_collisions(rows)


@query("SELECT l_orderkey || '-' || l_linenumber AS id FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT lower(l_returnflag)) > 1)")
def q_consistency(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").cast("string").alias("isolate_id"), "l_returnflag")
    return qc.taxonomy_consistency(rows, F.col("l_returnflag")).removed.select("id")


@query("""SELECT conv_id, CASE WHEN a IS NOT NULL THEN md5(a) END AS marker, CASE WHEN a IS NOT NULL THEN NULL WHEN any_a THEN 'length_out_of_bounds' ELSE 'no_alias_match' END AS reason FROM (
SELECT conv_id, arg_min(text, (-length(text), turn)) FILTER (WHERE role = 'assistant' AND length(text) BETWEEN 200 AND 900) AS a, bool_or(role = 'assistant') AS any_a FROM conversations GROUP BY 1)""")
def q_marker_pick(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    p = F.struct("turn", F.col("turn").cast("string").alias("protein_id"), F.col("role").alias("product"), F.length("text").alias("length"), F.col("text").alias("sequence"))
    rows = t.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(p)), lambda x: x.dropFields("turn")).alias("proteins"))
    got = markers.with_marker(rows, [markers.Spec("reply", aliases=("assistant",), bounds=(200, 900))])
    return got.select("conv_id", F.md5("marker.sequence").alias("marker"), "marker.reason")


@query("""SELECT page_id AS id, 'unknown' AS source, coalesce(nullif(regexp_extract(url, '^(\\S+)', 1), ''), '') AS accession, url AS description FROM pages""")
def q_header_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), header_fields(F.col("url")).alias("f"))
    return rows.select("id", "f.source", "f.accession", "f.description")


@query("""SELECT conv_id || '-' || turn AS id, CASE role WHEN 'user' THEN 'U' WHEN 'assistant' THEN 'A' ELSE role END AS segment FROM conversations""")
def q_segment_names(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    got = isolates.segment_of(F.col("role"), F.lit(""), ["U", "A"], None, {"U": ["user"], "A": ["assistant"]})
    return t.select(F.concat_ws("-", "conv_id", "turn").alias("id"), got.alias("segment"))


@query(f"""WITH p AS (SELECT * FROM ({_PARTS}) WHERE nth = 1 AND role IN ('user', 'assistant')), g AS (SELECT conv_id FROM p GROUP BY 1 HAVING count(*) = 2), b AS (SELECT *, CASE role WHEN 'user' THEN 1 ELSE 2 END AS o,
CASE WHEN role = 'user' AND length(text) < 150 OR role = 'assistant' AND length(text) > 800 THEN 'segment_length:' || role || ':' || length(text) END AS bad FROM p JOIN g USING (conv_id)),
f AS (SELECT conv_id, arg_min(bad, o) FILTER (WHERE bad IS NOT NULL) AS reason FROM b GROUP BY 1) SELECT conv_id || '-' || turn AS id, reason FROM b JOIN f USING (conv_id) WHERE reason IS NOT NULL""")
def q_part_lengths(spark, sf_dir):
    stage, _ = isolates.complete(_turns(spark, sf_dir), _VIRUS)
    return isolates.part_lengths(stage.kept, {"user": (150, None), "assistant": (None, 800)}).removed.select("id", "reason")


def _with_proteins(spark, sf_dir) -> DataFrame:
    """Conversations as records whose proteins are the turns."""
    p = F.struct("turn", F.col("turn").cast("string").alias("protein_id"), F.col("role").alias("product"), F.length("text").alias("length"), F.col("text").alias("sequence"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(p)).alias("p"))
    kind = "array<struct<protein_id:string,product:string,length:int,sequence:string>>"
    return rows.select(F.col("conv_id").cast("string").alias("id"), F.lit(None).cast("string").alias("segment"), F.transform("p", lambda x: x.dropFields("turn")).cast(kind).alias("proteins"))


@query("SELECT CAST(conv_id AS VARCHAR) AS id, 'too_few_proteins:' || count(*) AS reason FROM conversations GROUP BY conv_id HAVING count(*) < 4")
def q_protein_count(spark, sf_dir):
    return qc.protein_count(_with_proteins(spark, sf_dir), 4).removed.select("id", "reason")


@query("""SELECT CAST(conv_id AS VARCHAR) AS id FROM conversations GROUP BY conv_id
HAVING max(CASE WHEN coalesce(length(text), 0) = 0 THEN 1.0 ELSE length(regexp_replace(text, '[^XBZJxbzj]', '', 'g')) / length(text) END) > 0.03""")
def q_protein_quality(spark, sf_dir):
    return qc.protein_quality(_with_proteins(spark, sf_dir), 0.03).removed.select("id")


@query("""SELECT CAST(conv_id AS VARCHAR) AS id, role AS target, min(length(text) / 1000) AS dom_evalue FROM (SELECT conv_id, role, text FROM conversations UNION ALL
SELECT c.conv_id, r.role, NULL FROM (SELECT DISTINCT conv_id FROM conversations) c, (VALUES ('user'), ('assistant'), ('tool')) r(role)) WHERE role IN ('user', 'assistant', 'tool') GROUP BY 1, 2""")
def q_hit_grid(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("id"), F.col("role").alias("target"), (F.length("text") / 1000).alias("dom_evalue"))
    return reports.hit_grid(t.select("id").distinct(), ["user", "assistant", "tool"], t)


@query("""SELECT 'source' AS stratified_by, source AS stratum, count(*) AS stratum_size_before, least(3, count(*)) AS stratum_size_after FROM documents GROUP BY source""")
def q_group_counts(spark, sf_dir):
    from . import outputs

    rows = records(spark, sf_dir)
    w = Window.partitionBy("host").orderBy(*select.priority())
    none = lambda k: F.lit(None).cast(k)
    members = rows.select(F.col("host").alias("stratum"), F.col("id").alias("member_id"), (F.row_number().over(w) <= 3).alias("is_rep"), none("double").alias("cutoff"), none("int").alias("trimmed_from"))
    return outputs.group_counts(members, "source").select("stratified_by", "stratum", "stratum_size_before", "stratum_size_after")


@query(f"""SELECT 'host' AS stratified_by, host AS stratum, id, host AS value, 'attribute' AS matched_by, k = 1 AS is_representative FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY is_refseq DESC, is_reviewed DESC, length(sequence) DESC, input_ord) AS k FROM ({RECORDS}))""")
def q_group_assignments(spark, sf_dir):
    from . import outputs

    rows = bind.resolve_field(as_records(records(spark, sf_dir)), "host", out="group_host")
    reps = select.elect(rows, ["host"])
    return outputs.group_assignments(rows, ["host"], reps).select("stratified_by", "stratum", "id", "value", "matched_by", "is_representative")


@query(r"""SELECT doc_id AS id, md5('>' || doc_id || ' ' || source || chr(10) || regexp_replace(regexp_replace(b, '(.{70})', '\1' || chr(10), 'g'), chr(10) || '$', '')) AS entry FROM (SELECT doc_id, source, regexp_replace(text, '\s', '', 'g') AS b FROM documents)""")
def q_fasta_entries(spark, sf_dir):
    from ..sources.fasta import fasta_lines

    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.md5(fasta_lines(F.concat_ws(" ", F.col("doc_id").cast("string"), "source"), F.regexp_replace("text", r"\s", ""))).alias("entry"))


@query("""SELECT s_suppkey AS id, CASE WHEN lower(n_name) = 'china' THEN 'Homo sapiens' ELSE n_name END AS host, r_name AS country, CAST(1990 + s_suppkey % 20 AS VARCHAR) AS collection_date, CASE WHEN s_suppkey % 2 = 0 THEN 'H' || (s_suppkey % 10) || 'N1' END AS subtype
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def q_strain_parts(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    host = F.when(F.lower("n_name") == "china", "human").otherwise(F.col("n_name"))
    tail = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("(H"), (F.col("s_suppkey") % 10).cast("string"), F.lit("N1)"))).otherwise("(mixed, partial)")
    strain = F.concat(F.lit("A/"), host, F.lit("/"), F.replace("r_name", F.lit(" "), F.lit("_")), F.lit("/"), F.col("s_suppkey").cast("string"), F.lit("/"), (1990 + F.col("s_suppkey") % 20).cast("string"), tail)
    return s.withColumn("strain", strain).select(F.col("s_suppkey").alias("id"), *(c.alias(k) for k, c in X.strain_parts(F.col("strain")).items()))


@query("SELECT p_partkey AS id, md5(p_name) AS md5, sha256(p_name) AS sha256, regexp_replace(lower(trim(regexp_replace(p_type, '[^A-Za-z0-9]+', '_', 'g'), '_')), '^[0-9_]+', '') AS key FROM part")
def q_hash_and_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.md5("p_name").alias("md5"), F.sha2("p_name", 256).alias("sha256"), X.label_key(F.col("p_type")).alias("key"))


@query("""WITH n AS (SELECT n_name, r_name, n_nationkey, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT 'geo' AS tree, node_id, rank, name, 1.0::DOUBLE AS share FROM (
SELECT CAST(n_nationkey + 100 AS INT) AS node_id, 'genus' AS rank, n_name AS name FROM n WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT CAST(s_suppkey + 1000 AS INT), 'genus', n_name FROM supplier JOIN n ON s_nationkey = n_nationkey
UNION ALL SELECT CAST(n_regionkey + 1 AS INT), CASE WHEN count(DISTINCT n_nationkey) = 1 THEN 'genus' ELSE 'family' END, CASE WHEN count(DISTINCT n_nationkey) = 1 THEN min(n_name) ELSE min(r_name) END FROM supplier JOIN n ON s_nationkey = n_nationkey GROUP BY n_regionkey)""")
def q_lca_label(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    step = lambda r, c: F.struct(F.lit(r).alias("rank"), F.col(c).alias("name"))
    lineage = s.select(F.col("s_suppkey").cast("string").alias("leaf"), F.array(step("family", "r_name"), step("genus", "n_name")).alias("lineage"))
    rows = _geo_nodes(spark, sf_dir).select("tree", "node_id", F.explode("leaves").alias("leaf")).join(lineage, "leaf", "left")
    return trees.lca_label(rows)


# --- alignments and trees ---------------------------------------------------------------------------

_MSA = "SELECT p_partkey AS id, rpad(upper(p_type), CAST((SELECT max(length(p_type)) FROM part) AS INT), '-') AS r FROM part"
_COLS = f"SELECT id, i AS col, r[i + 1] AS ch FROM (SELECT id, r, unnest(range(0, length(r))) AS i FROM ({_MSA}))"
_WEIGHTS = f"SELECT id, w / sum(w) OVER () AS w FROM (SELECT id, sum(1.0 / (k * n)) AS w FROM ({_COLS}) JOIN (SELECT col, ch, count(*) AS n FROM ({_COLS}) GROUP BY 1, 2) USING (col, ch) JOIN (SELECT col, count(DISTINCT ch) AS k FROM ({_COLS}) GROUP BY 1) USING (col) GROUP BY 1)"
_BG = {k: v / sum(trees.PROTEIN_BG.values()) for k, v in trees.PROTEIN_BG.items()}


def _msa(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("row"))


@query(f"SELECT id, round(w, 9) AS w FROM ({_WEIGHTS})")
def q_henikoff(spark, sf_dir):
    return trees.henikoff(trees.columns(_msa(spark, sf_dir))).select("id", F.round("w", 9).alias("w"))


@query(f"""WITH bg(ch, q) AS (VALUES {", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in _BG.items())}), p AS (SELECT col, CASE WHEN ch IN (SELECT ch FROM bg) THEN ch END AS ch, sum(w) AS w FROM ({_COLS}) JOIN ({_WEIGHTS}) USING (id) GROUP BY 1, 2),
o AS (SELECT col, sum(w) AS occ FROM p WHERE ch IS NOT NULL GROUP BY 1), g AS (SELECT c.col, bg.ch, bg.q, coalesce(p.w / o.occ, 0) AS p, coalesce(o.occ, 0) AS occ FROM (SELECT DISTINCT col FROM p) c CROSS JOIN bg LEFT JOIN p ON p.col = c.col AND p.ch = bg.ch LEFT JOIN o ON o.col = c.col)
SELECT CAST(col AS INT) AS col, round(CASE WHEN max(occ) > 0 THEN least(1, greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + q * log2(q / ((p + q) / 2))) / 2)) ELSE 0 END, 6) AS jsd, round(max(occ), 6) AS occupancy FROM g GROUP BY col""")
def q_conservation_jsd(spark, sf_dir):
    return trees.conservation(_msa(spark, sf_dir), protein=True).select("col", F.round("jsd", 6).alias("jsd"), F.round("occupancy", 6).alias("occupancy"))


@query("""WITH p AS (SELECT l_orderkey AS id, l_linenumber AS part, min(l_returnflag || l_linestatus || CAST(CAST(l_quantity AS INT) AS VARCHAR)) AS r FROM lineitem GROUP BY 1, 2), w AS (SELECT part, max(length(r)) AS w FROM p GROUP BY 1),
g AS (SELECT i.id, w.part, w.w, p.r FROM (SELECT DISTINCT id FROM p) i CROSS JOIN w LEFT JOIN p ON p.id = i.id AND p.part = w.part) SELECT id, string_agg(coalesce(r, repeat('-', w)), '' ORDER BY part) AS "row", count(r) AS n_parts FROM g GROUP BY id""")
def q_supermatrix(spark, sf_dir):
    return trees.supermatrix(_parts(spark, sf_dir))


def _parts(spark, sf_dir) -> DataFrame:
    cell = F.concat("l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("part")).agg(F.min(cell).alias("row"))


@query("""WITH w AS (SELECT l_linenumber AS part, max(length(l_returnflag || l_linestatus || CAST(CAST(l_quantity AS INT) AS VARCHAR))) AS w FROM (SELECT l_orderkey, l_linenumber, arg_min(l_returnflag, k) AS l_returnflag, arg_min(l_linestatus, k) AS l_linestatus, arg_min(l_quantity, k) AS l_quantity
FROM (SELECT *, l_returnflag || l_linestatus || CAST(CAST(l_quantity AS INT) AS VARCHAR) AS k FROM lineitem) GROUP BY 1, 2) GROUP BY 1) SELECT part, CAST(sum(w) OVER (ORDER BY part) - w + 1 AS BIGINT) AS start, CAST(sum(w) OVER (ORDER BY part) AS BIGINT) AS stop FROM w""")
def q_partition_ranges(spark, sf_dir):
    return trees.partition_ranges(_parts(spark, sf_dir))


_TREES = """SELECT 'region' AS tree, list(n_name) AS leaves FROM nation GROUP BY n_regionkey UNION ALL SELECT 'initial', list(n_name) FROM nation GROUP BY n_name[1]
UNION ALL SELECT 'parity', list(n_name) FROM nation GROUP BY n_nationkey % 4 UNION ALL SELECT t, (SELECT list(n_name) FROM nation) FROM (VALUES ('region'), ('initial'), ('parity')) v(t)"""


@query(f"""WITH t AS ({_TREES}), c AS (SELECT list_sort(list(n_name)) AS common, min(n_name) AS least, count(*) AS n FROM nation), s AS (SELECT DISTINCT tree, array_to_string(list_sort(CASE WHEN list_contains(leaves, least) THEN list_filter(common, lambda x: NOT list_contains(leaves, x)) ELSE leaves END), '|') AS s
FROM t, c WHERE len(leaves) BETWEEN 2 AND n - 2), p AS (SELECT a.tree AS tree_a, b.tree AS tree_b FROM (SELECT DISTINCT tree FROM t) a, (SELECT DISTINCT tree FROM t) b WHERE a.tree < b.tree)
SELECT tree_a, tree_b, CAST(rf AS INT) AS rf, round(rf / (2.0 * (n - 3)), 6) AS norm_rf, CAST(n AS INT) AS n_common FROM (SELECT *, (SELECT count(*) FROM s WHERE tree = tree_a AND s NOT IN (SELECT s FROM s WHERE tree = tree_b)) + (SELECT count(*) FROM s WHERE tree = tree_b AND s NOT IN (SELECT s FROM s WHERE tree = tree_a)) AS rf FROM p), c""")
def q_rf_distance(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    clade = lambda name, key: n.groupBy(key).agg(F.collect_list("n_name").alias("leaves")).select(F.lit(name).alias("tree"), "leaves")
    parts = [clade("region", F.col("n_regionkey")), clade("initial", F.substring("n_name", 1, 1)), clade("parity", F.col("n_nationkey") % 4), *(clade(t, F.lit(1)) for t in ("region", "initial", "parity"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return trees.rf_distances(out).withColumn("norm_rf", F.round("norm_rf", 6))


def _geo_nodes(spark, sf_dir) -> DataFrame:
    """World, region, nation and supplier as nodes with their suppliers."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("string").alias("leaf"), F.col("n_nationkey").cast("int").alias("nation"), F.col("n_regionkey").cast("int").alias("region"))
    node = lambda k, parent: s.groupBy(k.alias("node_id"), parent.alias("parent_id")).agg(F.collect_list("leaf").alias("leaves"))
    world, region, nation = F.lit(0), F.col("region") + 1, F.col("nation") + 100
    parts = node(world, F.lit(None).cast("int")).unionByName(node(region, world)).unionByName(node(nation, region)).unionByName(node(F.col("leaf").cast("int") + 1000, nation))
    return parts.select(F.lit("geo").alias("tree"), "node_id", "parent_id", "leaves")


_GEO = """leaf AS (SELECT CAST(s_suppkey AS VARCHAR) AS leaf, s_suppkey + 1000 AS k, n_nationkey + 100 AS nation, n_regionkey + 1 AS region, {label} AS taxon FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
node AS (SELECT 0 AS k, NULL AS up, list(leaf) AS have FROM leaf UNION ALL SELECT region, 0, list(leaf) FROM leaf GROUP BY 1 UNION ALL SELECT nation, region, list(leaf) FROM leaf GROUP BY 1, 2 UNION ALL SELECT k, nation, [leaf] FROM leaf),
taxa AS (SELECT taxon, list(leaf) AS members FROM leaf GROUP BY 1 HAVING count(*) >= 2),
m AS (SELECT taxon, members, arg_min(have, (len(have), k)) AS span FROM taxa, node WHERE len(list_filter(members, lambda x: NOT list_contains(have, x))) = 0 GROUP BY 1, 2),
i AS (SELECT *, list_filter(span, lambda x: NOT list_contains(members, x)) AS intruders FROM m),
own AS (SELECT taxon, count(*) AS n FROM i, node WHERE len(list_filter(have, lambda x: NOT list_contains(members, x))) = 0 AND NOT EXISTS (SELECT 1 FROM node u WHERE u.k = node.up AND len(list_filter(u.have, lambda x: NOT list_contains(i.members, x))) = 0) GROUP BY 1),
oth AS (SELECT taxon, count(*) AS n FROM i, node WHERE len(list_filter(have, lambda x: NOT list_contains(intruders, x))) = 0 AND NOT EXISTS (SELECT 1 FROM node u WHERE u.k = node.up AND len(list_filter(u.have, lambda x: NOT list_contains(i.intruders, x))) = 0) GROUP BY 1)
SELECT 'geo' AS tree, '{rank}' AS rank, taxon, CAST(len(members) AS INT) AS n_leaves, CASE WHEN len(intruders) = 0 THEN 'monophyletic' WHEN oth.n = 1 THEN 'paraphyletic' ELSE 'polyphyletic' END AS status,
CASE WHEN len(intruders) = 0 THEN 1 ELSE own.n END AS n_clusters, CAST(len(intruders) AS INT) AS n_intruders, CASE WHEN len(intruders) = 0 THEN 0 ELSE oth.n END AS intruder_clusters,
coalesce((SELECT string_agg(DISTINCT l.taxon, ';' ORDER BY l.taxon) FROM leaf l WHERE list_contains(i.intruders, l.leaf)), '') AS intruder_taxa FROM i LEFT JOIN own USING (taxon) LEFT JOIN oth USING (taxon)"""
_BALANCE = "CASE WHEN s_acctbal > 5000 THEN 'rich' ELSE 'poor' END"
_MONO = " UNION ALL ".join(f"SELECT * FROM (WITH {_GEO.format(label=label, rank=rank)})" for rank, label in (("family", "r_name"), ("genus", _BALANCE)))


def _mono(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    leaf = F.col("s_suppkey").cast("string").alias("leaf")
    labels = s.select(leaf, F.lit("family").alias("rank"), F.col("r_name").alias("taxon")).unionByName(s.select(leaf, F.lit("genus").alias("rank"), F.when(F.col("s_acctbal") > 5000, "rich").otherwise("poor").alias("taxon")))
    return trees.monophyly(_geo_nodes(spark, sf_dir), labels)


@query(_MONO)
def q_monophyly(spark, sf_dir):
    return _mono(spark, sf_dir)


@query(f"SELECT rank, taxon, count(*) AS n_trees, count(*) FILTER (WHERE status <> 'monophyletic') AS n_broken, coalesce(string_agg(CASE WHEN status <> 'monophyletic' THEN tree END, ','), '') AS broken, count(*) FILTER (WHERE status <> 'monophyletic') = 1 AS single_break FROM ({_MONO}) GROUP BY 1, 2")
def q_segment_status(spark, sf_dir):
    return reports.segment_status(_mono(spark, sf_dir))


# --- extension --------------------------------------------------------------------------------------


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q_event_windows(spark, sf_dir):
    got = windows.window_counts(windows.dedup_stream(table(spark, sf_dir, "events"), ["event_id"]), ["event_type"], "value")
    return got.withColumn("total", F.round("total", 4))
