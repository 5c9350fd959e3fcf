from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from seqpick.operators import alarms as A
from seqpick.operators import bind, reports, select, trees
from seqpick.operators.markers import Spec
from seqpick.operators.polyprotein import Peptide, Polyprotein
from seqpick.sources import profiles, stores


def test_alarms(spark):
    lost = spark.createDataFrame([("family", "F", 3), ("genus", "b", 1), ("genus", "a", 1), ("genus", "c", 9)], "rank string, taxon string, n long")
    labels = spark.createDataFrame([("2.3", 4, "length")], "value string, n long, stage string")
    walls = spark.createDataFrame([("T", "s", 4, 0, 4, 5, True), ("U", "s", 4, 1, 3, 5, True), ("V", "s", 4, 4, 0, 5, False)], "taxon string, home string, peptides int, covered int, zeros int, n int, alarm boolean")
    mono = [("genome", "genus", "P", 5, "polyphyletic", 2, "Q"), ("genome", "genus", "R", 5, "paraphyletic", 1, ""), ("genome", "genus", "S", 5, "monophyletic", 1, ""), ("HA", "genus", "S", 5, "polyphyletic", 1, "X"), ("NA", "genus", "S", 5, "paraphyletic", 1, "X"), ("M", "genus", "S", 5, "monophyletic", 1, ""), ("HA", "genus", "Z", 5, "polyphyletic", 1, "X")]
    mono = spark.createDataFrame(mono, "tree string, rank string, taxon string, n_leaves int, status string, n_clusters int, intruder_taxa string")
    far = spark.createDataFrame([(f"t{i:02}", "u", 4, i / 20, 8) for i in range(20)] + [("x", "y", 0, None, 3)], "tree_a string, tree_b string, rf int, norm_rf double, n_common int")
    review = spark.createDataFrame([("g", "l1", "A", "B", 1.0, "conflict"), ("g", "l2", None, "B", 1.0, "impute")], "tree string, leaf string, own string, value string, share double, action string")
    got = A.collect(A.lost_taxa(lost), A.lost_labels(labels, "clade"), A.walls(walls), A.broken_taxa(mono, "genome"), A.incongruent(far), A.contradicted(review, "genus"))
    rows = [(r.category, r.severity, r.subject) for r in got.collect()]
    assert rows[:7] == [("qc_drop", "warn", s) for s in ("c (genus)", "a (genus)", "b (genus)", "F (family)")] + [("label_drop", "warn", "2.3 (clade)"), ("polyprotein_wall", "warn", "T (genus)"), ("polyprotein_wall", "warn", "U (genus)")]
    assert rows[7] == ("reassortment", "warn", "S (genus)") and "HA, NA" in got.where("subject = 'S (genus)'").first().message
    assert [r[2] for r in rows[8:23]] == [f"t{i:02} / u" for i in range(19, 4, -1)]
    assert rows[23:] == [("monophyly", "warn", "P (genus)"), ("monophyly", "info", "R (genus)"), ("taxonomy", "warn", "l1")]
    text = [r.value for r in A.lines(got).collect()]
    assert text[0] == "## Taxa that lost every record to cleaning" and sum(t.startswith("## ") for t in text) == 6 and sum(t.startswith("- ") for t in text) == 1 and len(text) == 6 + 26
    assert "strongly" in [t for t in text if "t10" in t][0] and "notably" in [t for t in text if "t09" in t][0] and "unlabelled leaves" in [t for t in text if "R (genus)" in t][0]
    assert [r.value for r in A.lines(A.collect(A.lost_taxa(lost.limit(0)))).collect()] == ["No alarms."]


def test_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('a"b', None, True), ("", "x\ty", False), (" s ", "\\", None)], "a string, b string, c boolean")
    stores.write_tsv(df, str(tmp_path / "t"))
    got = stores.read_tsv(spark, str(tmp_path / "t"))
    assert got.columns == ["a", "b", "c"] and sorted(map(tuple, got.collect()), key=str) == sorted([('a"b', None, "TRUE"), (None, "x y", "FALSE"), (" s ", "\\", "FALSE")], key=str)


def test_secrets_and_entries(spark, tmp_path):
    cfg = {"mode": "host", "ncbi": {"api_key": "s", "email": "e", "keywords": ["k"]}, "_run": 1, "list": [{"password": 1, "ok": (1, 2)}]}
    assert stores.without_secrets(cfg) == {"mode": "host", "ncbi": {"keywords": ["k"]}, "list": [{"ok": [1, 2]}]}
    schema = "id string, accession string, organism string, sequence string, isolate_id string, concat_segments array<struct<segment:string,accession:string>>, group_labels map<string,string>"
    reps = spark.createDataFrame([("c", "x", "o", "AA", "iso", [("S", "a1"), ("L", "a2"), (None, "a3"), ("S", "a4")], {"clade": "1"}), ("d", "acc", "o", "A", None, None, {})], schema)
    stores.write_lockfile(spark, str(tmp_path / "lock"), cfg, [], reps, "host -n 5", {"sha256": "x", "n_profiles": 2})
    head, entries = stores.read_lockfile(spark, str(tmp_path / "lock"))
    assert head["command"] == "host -n 5" and head["profiles"]["n_profiles"] == 2 and head["tools"]["pyspark"] == spark.version
    c, d = entries.orderBy("id").collect()
    assert (c.kind, c.accession, c.isolate_id, c.segment_accessions, c.group_labels) == ("isolate", None, "iso", {"S": "a4", "L": "a2"}, {"clade": "1"})
    assert (d.kind, d.accession, d.isolate_id, d.segment_accessions, d.group_labels) == ("sequence", "acc", None, None, None)


PROFILE = "HMMER3/f\nNAME  {}\nACC   PF{}\nLENG  {}\n{}HMM    A C\n  1.0\n//\n"


def test_profiles(spark, tmp_path):
    folder = tmp_path / "sets" / "Fam"
    folder.mkdir(parents=True)
    (folder / "b.hmm").write_text(PROFILE.format("B1", 1, 10, "GA    20.0 18.5;\n") + PROFILE.format("B2", 2, 11, ""))
    (folder / "a.hmm").write_text(PROFILE.format("A1", 3, 12, "").rstrip("\n"))
    (folder / "notes.txt").write_text(PROFILE.format("NO", 4, 1, ""))
    (folder / "one.db").write_text(PROFILE.format("X", 5, 9, ""))
    got = profiles.read_profiles(spark, "Fam", str(tmp_path / "sets"))
    assert [(r.file, r.name, r.accession, r.length, r.cutoff) for r in got.orderBy("file", "place").collect()] == [("a.hmm", "A1", "PF3", 12, None), ("b.hmm", "B1", "PF1", 10, 18.5), ("b.hmm", "B2", "PF2", 11, None)]
    assert [r.name for r in profiles.read_profiles(spark, str(folder / "one.db")).collect()] == ["X"]
    assert profiles.read_profiles(spark, None, str(folder)).count() == 3
    for bad in (dict(database="none", shipped=str(tmp_path)), dict()):
        with pytest.raises(ValueError, match="no database"):
            profiles.read_profiles(spark, **bad)
    with pytest.raises(ValueError, match="no profiles"):
        profiles.read_profiles(spark, str(tmp_path / "sets" / "Fam" / "notes.txt").replace("notes.txt", "") + "../../sets")
    profiles.write_profiles(got, str(tmp_path / "out.hmm"))
    (tmp_path / "joined").mkdir()
    (tmp_path / "joined" / "all.hmm").write_text("".join(p.read_text() for p in sorted((tmp_path / "out.hmm").glob("part*"))))
    again = profiles.read_profiles(spark, str(tmp_path / "joined"))
    assert profiles.fingerprint(again) == profiles.fingerprint(got.orderBy(F.desc("name"))) and profiles.fingerprint(got)["n_profiles"] == 3
    text = "".join(p.read_text() for p in sorted((tmp_path / "out.hmm").glob("part*")))
    assert text.count("\n//\n") == 3 and text.index("A1") < text.index("B1") < text.index("B2")
    specs, poly = [Spec("m", hmms=("A1--Q", "B1"))], [Polyprotein([Peptide("p", ("Z",))])]
    assert profiles.needed(specs, poly) == {"A1", "Q", "B1", "Z"} and [r.name for r in profiles.unknown(got, specs, poly).orderBy("name").collect()] == ["Q", "Z"]
    assert profiles.needs_scan(specs) and profiles.needs_scan((), poly) and not profiles.needs_scan([Spec("m", aliases=("x",))])


def test_fetch_only_missing(spark, records):
    p = lambda i: {"protein_id": i, "product": "x", "length": 1, "sequence": "M", "hmm_hits": []}
    df = records({"accession": "a", "proteins": [p("own")]}, {"accession": "b"}, {"accession": "a"}, {"accession": "c", "source": "uniprot"}, {"accession": " "}, {"accession": "z"})
    fetched = df.sparkSession.createDataFrame([(k, [p(f"new-{k}")]) for k in "abc"], f"accession string, proteins {df.schema['proteins'].dataType.simpleString()}")
    got = {r.id: r.proteins and r.proteins[0].protein_id for r in profiles.attach_missing(df, fetched).collect()}
    assert got == {"r0": "own", "r1": "new-b", "r2": "new-a", "r3": None, "r4": None, "r5": None}


def test_null_keys_are_spread(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("k"), F.lit(1).alias("_salt"))
    side = spark.range(0, 4000, 2).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = bind.known_join(df, side, "k")
        sizes = [r.n for r in out.where("k is null").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert out.count() == 4000 and out.where("v = 'v'").count() == 2000 and set(out.columns) == {"id", "k", "_salt", "v"}
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(k" in plan and "__salt" in plan and max(sizes) <= 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_phyloxml_round_trip(spark):
    rows = trees.parse_newick("t", "((a:1,'b & c':2)90:0.5,(d,e)80,f);")
    nodes = spark.createDataFrame(rows, trees.NODE + ", length double")
    labels = spark.createDataFrame([("a", "genus", "G<"), ("a", "family", "F"), ("f", "genus", "H"), ("q", "genus", "no")], "leaf string, rank string, taxon string")
    r = trees.phyloxml(nodes, labels).first()
    back, props = trees.parse_phyloxml("t", r.xml)
    shape = lambda rs: sorted((x[3], x[4], x[5]) for x in rs if x[5]) + sorted(x[4] for x in rs if x[4] is not None)
    assert shape(back) == shape(rows) and len(back) == len(rows)
    assert sorted(props) == [("a", "family", "F"), ("a", "genus", "G<"), ("f", "genus", "H")]
    lengths = [float(e.text) for e in ElementTree.fromstring(r.xml).iter() if e.tag.endswith("branch_length")]
    assert lengths == [0.5, 1.0, 2.0]
    deep = spark.createDataFrame([("d", i, i - 1 if i else None, i, None, "x" if i == 5000 else None) for i in range(5001)], trees.NODE)
    assert trees.phyloxml(deep).first().xml.count("<clade>") == 5001


def test_text_table(spark):
    df = spark.createDataFrame([("b", 5, None), ("a\n c", 1000, 0.5)], "name string, n int, share double")
    assert [r.value for r in reports.text_table(df, ["name"]).collect()] == ["name     n  share", "----  ----  -----", "a c   1000    0.5", "b        5      -"]
    assert [r.value for r in reports.text_table(df.limit(0), ["name"]).collect()] == ["name  n  share", "----  -  -----"]


def test_display_order(spark, records):
    df = records(*({"id": i} for i in "abc"))
    clusters = spark.createDataFrame([("z", "a"), ("m", "b"), ("z", "c")], "stratum string, member_id string")
    assert [tuple(r) for r in select.display_order(clusters, df, "host").collect()] == [("z", 0, 2), ("m", 1, 1)]
    assert [r.stratum for r in select.display_order(clusters, df, "time").collect()] == ["m", "z"]
