import pytest
from pyspark.sql import functions as F

from seqpick.operators import bind, isolates, qc, reports, select


def ids(df, order="input_ord"):
    return [r.id for r in df.orderBy(order).collect()]


def log(df):
    return {(r.id, r.reason) for r in df.collect()}


def test_duplicates_keep_best_then_first(records):
    df = records({"sequence": "MK"}, {"sequence": "MK", "is_reviewed": True}, {"sequence": "MK", "is_refseq": True}, {"sequence": "ML"}, {"sequence": "ML"})
    got = qc.exact_duplicates(df)
    assert ids(got.kept) == ["r2", "r3"]
    assert log(got.removed) == {("r0", "exact_duplicate_of:r2"), ("r1", "exact_duplicate_of:r2"), ("r4", "exact_duplicate_of:r3")}


def test_protected_rows_stay_and_are_told(spark, records):
    df = records({"sequence": "MK"}, {"sequence": "MK"}, {"sequence": "M", "isolate_id": "i"}, {"sequence": "MMM", "isolate_id": "i"})
    protect = spark.createDataFrame([("R1.3",), ("r3",)], "id string")
    got = qc.exact_duplicates(df, protect)
    assert ids(got.kept) == ["r0", "r1", "r2", "r3"] and log(got.protected) == {("r1", "exact_duplicate_of:r0")}
    got = qc.length_bounds(df, 2, None, protect)  # the isolate's other record is on the list
    assert log(got.removed) == set() and log(got.protected) == {("r2", "length_too_short:1")}


def test_length_bounds_are_strict(records):
    df = records({"sequence": "MK"}, {"sequence": "MKL"}, {"sequence": "MKLE"}, {"sequence": "M"})
    got = qc.length_bounds(df, 2, 3)
    assert ids(got.kept) == ["r0", "r1"] and log(got.removed) == {("r2", "length_too_long:4"), ("r3", "length_too_short:1")}


def test_ambiguity_strictly_over(records):
    df = records({"sequence": "X" + "A" * 19}, {"sequence": "XX" + "A" * 18}, {"sequence": "NNNNNNNNNN", "seq_type": "nucleotide"})
    assert ids(qc.ambiguity_gate(df, 0.05).kept) == ["r0"]


def test_protein_gates_pass_null(records):
    p = lambda *s: [{"protein_id": "p", "product": "x", "length": len(x or ""), "sequence": x, "hmm_hits": None} for x in s]
    df = records({"sequence": "A", "proteins": None}, {"sequence": "A", "proteins": []}, {"sequence": "A", "proteins": p("MKLE")}, {"sequence": "A", "proteins": p("MXXX", "MKLE")}, {"sequence": "A", "proteins": p(None)})
    assert ids(qc.protein_count(df, 1).kept) == ["r0", "r2", "r3", "r4"]
    assert ids(qc.protein_quality(df).kept) == ["r0", "r1", "r2"]


def test_protein_quality_removes_siblings(records):
    p = [{"protein_id": "p", "product": "x", "length": 4, "sequence": "MXXX", "hmm_hits": None}]
    df = records({"sequence": "A", "isolate_id": "i", "proteins": p}, {"sequence": "A", "isolate_id": "i"}, {"sequence": "A", "isolate_id": "j"})
    got = qc.protein_quality(df, segmented=True)
    assert ids(got.kept) == ["r2"] and ("r1", "bad_protein_sibling") in log(got.removed)


def test_taxonomy_consistency(records):
    df = records({"organism": "Foo  bar", "isolate_id": "i", "sequence": "A"}, {"organism": "foo bar", "isolate_id": "i", "sequence": "A"}, {"organism": "x", "isolate_id": "j", "sequence": "A"}, {"organism": "y", "isolate_id": "j", "sequence": "A"}, {"organism": None, "sequence": "A"})
    assert ids(qc.taxonomy_consistency(df, F.col("organism")).kept) == ["r0", "r1", "r4"]


def test_blocklist(spark, records):
    df = records({"id": "AB1.1", "sequence": "A"}, {"id": "x", "accession": "CD2", "sequence": "A"}, {"id": "y", "sequence": "A"})
    kept, audit = qc.blocklist(df, spark.createDataFrame([("ab1",), ("cd2.9",), ("zz",), (" ",)], "id string"))
    assert ids(kept) == ["y"]
    assert {(r.id, r.action) for r in audit.collect()} == {("ab1", "excluded"), ("cd2.9", "excluded"), ("zz", "unavailable")}


def test_funnel_counts(records):
    df = records({"sequence": "MKLE"}, {"sequence": "MKLE"}, {"sequence": "M"}, {"sequence": "MKLX"}, {"sequence": "MKLLL", "description": "partial"})
    got = qc.run_basic(df, {"min_length": 2, "ambiguous_threshold": 0.1})
    counts = qc.counters(got.removed)
    assert {(r.stage, r.n) for r in counts.collect()} == {("duplicates", 1), ("length", 1), ("ambiguous", 1), ("annotation", 1)}
    run = qc.running_survivors(5, counts, list(qc.STAGES))
    assert [r.survivors for r in run.orderBy(F.desc("survivors")).collect()] == [4, 3, 2, 1]


@pytest.fixture
def table(spark):
    rows = [("r0.2", None, "x", 0), ("r1", None, "x", 1), ("r1", None, "y", 2), (None, "Iso 2", "z", 3), ("r3", None, None, 4)]
    return spark.createDataFrame(rows, "accession string, isolate string, clade string, row_id bigint")


def test_bind_value_conflict_unknown(records, table):
    df = records({"sequence": "A"}, {"sequence": "A"}, {"sequence": "A", "isolate_id": "iso  2"}, {"sequence": "A", "host": "h"}, {"sequence": "A", "header": "q clade=5"})
    got = bind.resolve_field(df, "clade", table, r"clade=(\d)")
    assert {r.id: (r.group.value, r.group.matched_by) for r in got.collect()} == {"r0": ("x", "table:accession"), "r1": ("Conflict", "conflict"), "r2": ("z", "table:isolate"), "r3": ("Unknown", "none"), "r4": ("5", "header_regex")}
    assert bind.coverage(got) == {"table": 2, "other": 1, "conflict": 1, "unknown": 1}
    with pytest.raises(ValueError, match="no record"):
        bind.coverage(bind.resolve_field(df, "nothing"))


def test_enrich(spark, records):
    df = records({"sequence": "A", "host": "old"}, {"sequence": "A", "host": ""}, {"sequence": "A", "host": "kept"})
    dim = spark.createDataFrame([("r0", "new"), ("r1", "new"), ("r2", " ")], "id string, host string")
    assert {r.id: r.host for r in bind.enrich(df, dim, "id", ["host"]).collect()} == {"r0": "new", "r1": "new", "r2": "kept"}
    assert {r.id: r.host for r in bind.enrich(df, dim, "id", ["host"], override=False).collect()} == {"r0": "old", "r1": "new", "r2": "kept"}


def test_isolate_features(spark, records):
    df = records({"id": "a", "sequence": "A"}, {"id": "b", "sequence": "A"}, {"id": "c", "sequence": "A", "isolate_id": "own", "isolate_id_source": "regex"})
    f = spark.createDataFrame([("a", "iso", "str", "4"), ("b", None, "str", None), ("c", "iso", None, None)], "accession string, isolate string, strain string, segment string")
    got = {r.id: (r.isolate_id, r.isolate_id_source, r.segment) for r in bind.enrich_isolates(df, f).collect()}
    assert got == {"a": ("iso", "isolate", "4"), "b": ("str", "strain", None), "c": ("own", "regex", None)}


VIRUS = {"segments": ["PB2", "HA", "M"], "isolate_regex": r"\((?P<isolate>[^)]+)\)", "segment_aliases": {"HA": ["hemagglutinin"], "M": ["matrix"]}}


@pytest.mark.parametrize(("segment", "header", "want"), [("2", "", "HA"), ("ha", "", "HA"), ("matrix", "", "M"), ("X9", "", "X9"), (None, "the hemagglutinin gene", "HA"), (None, "stray M here", None), (None, "x segment 3 y", "M"), (None, "segment 9", None), (None, "PB2 gene", "PB2")])
def test_segment_ladder(spark, segment, header, want):
    df = spark.createDataFrame([(segment, header)], "s string, h string")
    assert df.select(isolates.segment_of(F.col("s"), F.col("h"), VIRUS["segments"], None, VIRUS["segment_aliases"])).first()[0] == want


def test_assembly(records):
    row = lambda i, seg, seq, **k: {"id": i, "header": f"{i} (Iso {k.pop('iso', 1)})", "segment": seg, "sequence": seq} | k
    df = records(row("a", "3", "MM"), row("b", "1", "PP", is_refseq=True), row("c", "HA", "HHH", host="duck"), row("d", "HA", "HHHH"), row("e", "HA", "hhhh"), row("f", "1", "Q", iso=2), {"id": "g", "header": "none", "sequence": "A"}, row("h", "X", "XX"))
    stage, extras = isolates.complete(df, VIRUS)
    got = isolates.assemble(stage.kept).collect()
    assert [(r.id, r.sequence, r.is_refseq) for r in got] == [("CONCAT|iso_1", "PPHHHHMM", False)]
    assert [s.id for s in got[0].concat_segments] == ["b", "d", "a"]
    assert (got[0].proteins, got[0].protein_sequence, got[0].taxonomy) == (None, None, None)
    keyed = stage.kept.select("isolate_key", "segment")
    assert isolates.complete_among(keyed, VIRUS["segments"], keyed) == 1
    assert log(stage.removed) == {("f", "incomplete_isolate:missing_segments:HA,M"), ("g", "segmented_filter:could_not_identify_isolate_or_segment")}
    assert [(r.isolate_key, r.extras) for r in extras.collect()] == [("iso_1", ["X"])]
    dropped, _ = isolates.complete(df, VIRUS, "drop")
    assert dropped.kept.count() == 0 and ("a", "extra_segments:X") in log(dropped.removed)
    short = isolates.part_lengths(stage.kept, {"PB2": (3, None), "HA": (9, None)})
    assert {r.reason for r in short.removed.collect()} == {"segment_length:PB2:2"} and short.kept.count() == 0


def test_assembly_joins_proteins(records):
    p = lambda n: [{"protein_id": n, "product": "x", "length": 1, "sequence": n, "hmm_hits": None}]
    df = records({"id": "a", "isolate_id": "i", "segment": "S", "sequence": "AA", "proteins": p("P"), "protein_sequence": "P", "taxonomy": {"genus": "late", "lineage": {}}}, {"id": "b", "isolate_id": "i", "segment": "L", "sequence": "CC", "proteins": [], "protein_sequence": "Q", "taxonomy": {"genus": "g", "lineage": {"x": "y"}}})
    df = df.withColumn("isolate_key", F.col("isolate_id")).withColumn("segment_ord", F.when(F.col("segment") == "L", 1).otherwise(2))
    r = isolates.assemble(df).first()
    assert (r.sequence, r.protein_sequence, [x.protein_id for x in r.proteins], r.taxonomy.genus) == ("CCAA", "QP", ["P"], "g")


def test_collisions(records):
    row = lambda i, src, seg="HA": {"id": i, "isolate_id": "s", "isolate_id_source": src, "segment": seg, "sequence": "A"}
    df = records(row("a", "strain"), row("b", "strain"), row("c", "isolate", "NA"), row("d", "strain", "M"))
    assert [(r.segment, r.accessions) for r in isolates.strain_collisions(df).collect()] == [("HA", ["a", "b"])]
    assert ids(isolates.drop_collisions(df).kept) == ["c", "d"]


def test_election_follows_priority(records):
    df = records({"sequence": "MKKKK", "host": "h"}, {"sequence": "MK", "host": "h", "is_refseq": True}, {"sequence": "MKK", "host": "h", "is_reviewed": True}, {"sequence": "MKKKK", "host": "g"}, {"sequence": "MLLLL", "host": "g"})
    assert {r.host: r.id for r in select.elect(df, ["host"]).collect()} == {"h": "r1", "g": "r3"}
    assert {r.host: r.id for r in select.elect(df, ["host"], 1, ("longest",)).collect()} == {"h": "r0", "g": "r3"}


def test_force_select(spark, records):
    df = records(*({"id": c, "sequence": "M" * (5 - i)} for i, c in enumerate("abcdef")))
    members = spark.createDataFrame([("c1", "a", True), ("c1", "b", False), ("c1", "c", False), ("c2", "d", True), ("c2", "e", False)], "cluster_id string, member_id string, is_rep boolean")
    pins = spark.createDataFrame([(x,) for x in ("B", "c", "d", "f", "zz")], "id string")
    clusters, audit = select.force_select(members, df, pins)
    assert {(r.id, r.action) for r in audit.collect()} == {("b", "elected_representative"), ("c", "split_singleton"), ("d", "already_representative"), ("f", "added_representative"), ("zz", "unavailable")}
    assert {(r.cluster_id, r.member_id) for r in clusters.where("is_rep").collect()} == {("c1", "b"), ("c1_pin1", "c"), ("c2", "d"), ("pin_000001", "f")}
    assert clusters.count() == 6


def test_tally_and_eliminated(records):
    df = records({"organism": "x", "host": "h", "sequence": "A"}, {"organism": "y", "host": " ", "sequence": "A"}, {"organism": "x", "host": None, "sequence": "A"})
    ranks = {"genus": F.col("organism"), "species": F.col("host")}
    before = reports.tally(df, ranks)
    assert {(r["rank"], r.taxon, r.n) for r in before.collect()} == {("genus", "x", 2), ("genus", "y", 1), ("species", "h", 1)}
    after = reports.tally(df.where("organism = 'x' and host is null"), ranks)
    assert {(r["rank"], r.taxon) for r in reports.eliminated(before, after).collect()} == {("genus", "y")}
    assert {(r.taxon, r.place) for r in reports.top_or_eliminated(before, after, 1).where("rank = 'genus'").collect()} == {("x", 1), ("y", 2)}


def test_purity(spark):
    df = spark.createDataFrame([("c", "a", 1), ("c", "a", 2), ("c", "b", 3), ("c", " ", 4), ("d", None, 5)], "c string, v string, n int")
    got = {r.cluster: (r.size, r.purity and round(r.purity, 4), r.n_distinct, r.median_length) for r in reports.purity(df, "c", F.col("v"), F.col("n")).collect()}
    assert got == {"c": (4, 0.6667, 2, 2), "d": (1, None, 0, 5)}


def test_walls(spark):
    rows = [("t", "A", p, h) for p, h in (("p1", True), ("p2", False), ("p3", False)) for _ in range(3)] + [("t", "B", "q", False)] * 3 + [("u", "A", "p1", False)] * 2
    got = {r.taxon: (r.home, r.covered, r.zeros, r.alarm) for r in reports.walls(spark.createDataFrame(rows, "t string, s string, peptide string, h boolean"), "t", "s", F.col("h")).collect()}
    assert got == {"t": ("A", 1, 2, True), "u": ("A", 0, 1, False)}


def test_label_table_withholds_mixed_units(spark):
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "clade string")
    got = {r.value: (r.n_pre, r.n_pool, r.n_reps, r.n_pre_shown) for r in reports.label_table(one("a", "a", "b"), one("a"), one("a"), "clade").collect()}
    assert got == {"a": (2, 1, 1, 2), "b": (1, 0, 0, 1)}
    assert all(r.n_pre_shown is None for r in reports.label_table(one("a"), one("a", "a"), one(), "clade").collect())


def test_subtype_shares(spark):
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "subtype string")
    got = {r.subtype: (r.n_before, r.n_after, r.share) for r in reports.subtype_shares(one("H5N1", "n/a", None, "H1"), one("H5N1", None)).collect()}
    assert got == {"H5N1": (1, 1, 0.5), None: (2, 1, 0.5), "H1": (1, 0, 0.0)}
    assert [r.share for r in reports.subtype_shares(one("H1"), one()).collect()] == [None]


def test_profile_and_tidy(records):
    df = records({"sequence": "A", "host": "h"}, {"sequence": "A", "host": ""})
    got = reports.profile(df, ["host", "id"])
    assert {r.field: (r.filled, r.share) for r in got.collect()} == {"host": (1, 0.5), "id": (2, 1.0)}
    rows = reports.tidy("profile", got, ["filled", "share"], spec="field").collect()
    assert len(rows) == 4 and rows[0].asDict().keys() == dict.fromkeys(reports.TIDY).keys()


def test_records_without_a_body_are_nobodys_copy(records):
    df = records({"sequence": None}, {"sequence": None}, {"sequence": "MK"}, {"sequence": "MK", "is_refseq": True}, {"sequence": ""}, {"sequence": ""}).withColumn("_best", F.lit("own"))
    got = qc.exact_duplicates(df)
    assert sorted(r.id for r in got.kept.collect()) == ["r0", "r1", "r3", "r4"] and set(got.kept.columns) == set(df.columns)
    assert {(r.id, r.reason) for r in got.removed.collect()} == {("r2", "exact_duplicate_of:r3"), ("r5", "exact_duplicate_of:r4")}
    basic = qc.run_basic(df, {"annotation_filter": False, "ambiguous_threshold": 1.0})
    assert sorted(r.id for r in basic.kept.collect()) == ["r0", "r1", "r3", "r4"]


def test_isolates_are_joined_not_windowed(records):
    df = records({"isolate_id": "a", "organism": "x"}, {"isolate_id": "a", "organism": "y"}, {"isolate_id": "b", "organism": "x"}, {"organism": "x"}, {"organism": "y"})
    got = qc.taxonomy_consistency(df, F.col("organism"))
    assert sorted(r.id for r in got.removed.collect()) == ["r0", "r1"] and got.kept.count() == 3
    assert "Window" not in got.kept._jdf.queryExecution().optimizedPlan().toString()
    protect = df.sparkSession.createDataFrame([("r0",)], "id string")
    assert sorted(r.id for r in qc.taxonomy_consistency(df, F.col("organism"), protect).kept.collect()) == [f"r{i}" for i in range(5)]


def test_nearest_among_many_targets(spark, monkeypatch):
    monkeypatch.setattr(bind, "TARGETS", 3)
    q = spark.createDataFrame([(i, float(i)) for i in range(20)], "query int, q double")
    t = spark.createDataFrame([(i, i, i * 3.0) for i in range(8)], "target int, ord int, t double")
    got = {r.query: r.target for r in bind.nearest(q, t, F.abs(F.col("q") - F.col("t"))).collect()}
    assert got == {i: min(range(8), key=lambda k: (abs(i - 3 * k), k)) for i in range(20)}
