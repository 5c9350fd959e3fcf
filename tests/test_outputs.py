import pytest
from pyspark.sql import functions as F

from seqpick.operators import bind, markers, qc
from seqpick.plans import outputs as O
from seqpick.plans import pipeline as P

BODIES = ["MKLEVNACDEFGH", "MKLEVNACDEFGA", "WYWYTTSSPPQQ"]


@pytest.fixture
def result(records):
    p = [{"protein_id": "p1", "product": "Spike\tprotein", "length": 4, "sequence": "MKLE", "hmm_hits": None}, {"protein_id": "p2", "product": "other", "length": 0, "sequence": None, "hmm_hits": None}]
    rows = [{"sequence": s, "host": "duck", "organism": "Foo [x]", "proteins": p, "group_labels": {"HA clade": "2.3", "host": "no"}, "taxonomy": {"taxid": 7, "genus": g, "lineage": {"subgenus": "S"}}} for s, g in zip(BODIES, "GGH", strict=True)]
    return P.run(records(*rows, {"sequence": "MK", "description": "partial", "taxonomy": {"genus": "Lost", "lineage": {}}}), P.Config(mode="host", n=1))


def test_tables(result):
    r = O.representatives(result.representatives).collect()
    assert len(r) == 1 and list(r[0].asDict()) == O.REPRESENTATIVE and r[0].subgenus == "S" and r[0].segments is None
    assert [(x.protein_id, x.genus) for x in O.proteins(result.representatives).orderBy("nth").collect()][0][0] == "p1"
    c = O.clusters(result).first()
    assert (c.size, c.genus_purity, c.genus_distinct, c.host_purity, c.median_length, c.species_purity) == (3, 0.667, 2, 1.0, 13, None)
    assert {(x.alarm, x.subject) for x in O.flags(result).collect()} >= {("eliminated", "genus:Lost")}


def test_group_counts_with_curve(spark, result):
    curve = spark.createDataFrame([("duck", 0.99, 3), ("duck", 0.7, 2), ("x", 0.7, None)], "stratum string, cutoff double, n_clusters int")
    g = O.group_counts(result.clusters, "host", curve).first()
    assert (g.stratum_size_before, g.stratum_size_after, g.clustered, g.clusters_before_trim, g["n_clusters_0.99"], g["n_clusters_0.7"]) == (3, 1, True, 2, 3, 2)


def test_protein_headers(result):
    rows = O.protein_fasta(result.representatives).collect()
    assert len(rows) == 1 and "[organism=Foo x]" in rows[0].header and "[ha_clade=2.3]" in rows[0].header and "[host=no]" not in rows[0].header and "[subgenus=S]" in rows[0].header and "[length=4]" in rows[0].header
    assert [r.spec for r in O.protein_fasta(result.representatives, {"spike p": ["SPIKE"], "none": ["zzz"]}).collect()] == ["spike_p"]


def test_write_all(spark, result, tmp_path):
    out = f"{tmp_path}/out"
    O.write_all(spark, result, P.Config(mode="host", n=1), out)
    text = "".join(p.read_text() for p in (tmp_path / "out/qc_removed").glob("part*"))
    assert "annotation_keyword:partial" in text and text.startswith("id\tstage\treason")
    assert "TRUE" not in text and (tmp_path / "out/proteins.fasta").is_dir() and "Methods" in "".join(p.read_text() for p in (tmp_path / "out/summary").glob("part*"))
    with pytest.raises(Exception, match="exist"):
        O.write_all(spark, result, P.Config(mode="host", n=1), out)


def test_assignments(spark, records):
    df = bind.resolve_field(records({"sequence": "A", "host": "b"}, {"sequence": "A", "host": "a"}), "host", out="group_host")
    got = O.group_assignments(df, ["host"], df.where("id = 'r0'")).collect()
    assert [(r.stratum, r.id, r.is_representative, r.matched_by) for r in got] == [("a", "r1", False, "attribute"), ("b", "r0", True, "attribute")]


@pytest.mark.parametrize(("a", "b", "c", "want"), [("x", "y", "z", "x|y|z"), ("x", None, "z", "x|z"), (None, "y", "z", "y|z"), ("x", "y", " ", "x|y"), (None, None, "z z", "z_z")])
def test_leaf_labels(spark, a, b, c, want):
    df = spark.createDataFrame([(a, b, c)], "a string, b string, c string")
    assert df.select(O.leaf_label("{a}|{b}|{c}", {k: F.col(k) for k in "abc"})).first()[0] == want


def test_strain_stands_in(spark):
    df = spark.createDataFrame([(None, "iso 1")], "s string, i string")
    assert df.select(O.leaf_label("<{strain}>", {"strain": F.col("s"), "isolate_id": F.col("i")})).first()[0] == "<iso_1>"


def test_label_config():
    assert O.check_labels(["ha clade"], ["HA clade", "id"]) == {"ha_clade": "HA clade"}
    for fields, message in ((["x"], "no column"), (["123"], "empty"), (["Host"], "reserved"), (["a b", "A-B"], "that of"), ([], "nothing")):
        with pytest.raises(ValueError, match=message):
            O.check_labels(fields, ["123", "Host", "a b", "A-B"])


def test_isolate_gate(records):
    hit = {"target": "A", "passing": True, "dom_evalue": 1e-9, "hmm_len": 1, "dom_score": 1.0, "hmm_from": 1, "hmm_to": 1, "ali_from": 1, "ali_to": 9, "ali_span": 9}
    p = lambda ok: [{"protein_id": "p", "product": "x", "length": 1, "sequence": "M", "hmm_hits": [hit] if ok else []}]
    row = lambda i, iso, seg, ok, s="AA": {"id": i, "isolate_id": iso, "segment": seg, "sequence": s, "proteins": p(ok)}
    df = records(row("a", "x", "L", True), row("b", "x", "M", False), row("c", "y", "L", False, "A"), row("d", "y", "L", True), row("e", None, "L", False), row("f", "x", "S", False))
    df = df.withColumn("isolate_key", F.col("isolate_id"))
    got = qc.gate(markers.isolate_gate(df, {"L": ("A", "B"), "M": ("A",)}), "hmm", F.col("_reason"))
    assert {(r.id, r.reason) for r in got.removed.collect()} == {("a", "hmm_failed_sibling:M:A"), ("b", "hmm_failed:M:A"), ("f", "hmm_failed_sibling:M:A")}


def test_fill_from_strain(records):
    df = records({"sequence": "A", "strain": "A/duck/Hong_Kong/1/1997(H5N1)", "host": "goose"}, {"sequence": "A", "header": "seen 2004"})
    got = {r.id: (r.host, r.country, r.collection_date, r.subtype) for r in bind.fill_from_strain(df).collect()}
    assert got == {"r0": ("goose", "Hong Kong", "1997", "H5N1"), "r1": (None, None, "2004", None)}


