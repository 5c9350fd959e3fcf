import pytest
from pyspark.sql import functions as F

from seqpick.operators import markers as M
from seqpick.operators import polyprotein as P
from seqpick.operators import reports


def hit(target, a=1, b=100, e=1e-20, ok=True, **k):
    return {"target": target, "passing": ok, "dom_evalue": e, "dom_score": 50.0, "hmm_len": 100, "hmm_from": 1, "hmm_to": 100, "ali_from": a, "ali_to": b, "ali_span": b - a + 1} | k


def prot(name, seq, *hits):
    return {"protein_id": name, "product": name, "length": len(seq or ""), "sequence": seq, "hmm_hits": list(hits)}


@pytest.mark.parametrize(("hits", "token", "want"), [
    ([hit("A", e=1e-5), hit("A", e=1e-9)], "A", 1e-9), ([hit("A", ok=False)], "A", None), ([], "A", None),
    ([hit("A", 1, 100, 1e-9), hit("B", 90, 200, 1e-7)], "A--B", 1e-7), ([hit("A", 1, 100), hit("B", 70, 200)], "A--B", None), ([hit("A", 1, 100), hit("B", 71, 200)], "A--B", 1e-20),
    ([hit("A", 1, 100), hit("B", 20, 90)], "A--B", None), ([hit("B", 1, 100), hit("A", 150, 200)], "A--B", None)])
def test_tokens(hits, token, want):
    assert M.token_evalue(hits, token) == want


def test_token_syntax():
    assert M.parse_token(" A -- B") == ["A", "B"]
    with pytest.raises(ValueError, match="empty"):
        M.parse_token("A----B")


def test_domains_are_authoritative():
    ps = [prot("long", "M" * 50), prot("dom", "M" * 10, hit("A"))]
    assert M.pick(ps, [M.Spec("x", hmms=("A",), aliases=("long",))]).protein["protein_id"] == "dom"
    assert M.pick(ps[:1], [M.Spec("x", hmms=("A",), aliases=("long",))]) == M.Pick(None, "hmm_failed", "x")
    assert M.pick(ps[:1], [M.Spec("x", hmms=("A",), aliases=("long",))], scanned=False).protein["protein_id"] == "long"


def test_aliases_in_order_then_longest():
    ps = [prot("spike protein", "M" * 10), prot("spike protein 2", "M" * 20), prot("other", "M" * 90)]
    assert M.pick(ps, [M.Spec("s", aliases=("nothing", "SPIKE"))]).protein["length"] == 20
    assert M.pick(ps, [M.Spec("s", aliases=("nothing",))]).protein["protein_id"] == "other"  # unbounded names fall back
    assert M.pick(ps, [M.Spec("s", aliases=("nothing",), bounds=(1, 99))]).reason == "no_alias_match"
    assert M.pick(ps, [M.Spec("s", aliases=("spike",), bounds=(30, None))]) == M.Pick(None, "length_out_of_bounds", "s", 20)
    assert M.pick([], []).reason == "no_proteins" and M.pick(None, []).reason == "no_proteins"


def test_met_start():
    ps = [prot("spike", "K" * 30), prot("other", "M" * 5)]
    assert M.pick(ps, [M.Spec("s", aliases=("spike",))], need_met=True).reason == "no_met_start"
    assert M.pick(ps, [], need_met=True).protein["protein_id"] == "other"
    got = M.pick([prot("a", "KK", hit("A")), prot("b", "MMMM", hit("A"))], [M.Spec("x", hmms=("A",), bounds=(None, 3))], need_met=True)
    assert got.reason == "no_met_start" and got.length == 2


def test_claiming_withholds_from_names():
    got, withheld = M.claim([prot("capsid", "MMM", hit("C"))], [M.Spec("byname", aliases=("capsid",)), M.Spec("bydomain", hmms=("C",))])
    assert got["bydomain"]["protein_id"] == "capsid" and got["byname"] is None and withheld == ["byname"]


def test_marker_column_and_gate(records):
    df = records({"sequence": "A", "proteins": [prot("p", "MKLE", hit("A"))]}, {"sequence": "A", "proteins": [prot("q", "MK")]}, {"sequence": "A", "proteins": None})
    got = {r.id: r.marker for r in M.with_marker(df, [M.Spec("x", hmms=("A",))]).collect()}
    assert (got["r0"].sequence, got["r1"].reason, got["r2"].reason) == ("MKLE", "hmm_failed", "no_proteins")
    joined = M.with_marker(df, [M.Spec("x", hmms=("A",)), M.Spec("y", aliases=("p",))], joined=True).where("id = 'r0'").first().marker
    assert joined.sequence == "MKLEMKLE"
    assert {r.id: r.failed_spec for r in M.domain_gate(df, {"x": ("A", "B"), "y": ("A",)}).collect()} == {"r0": None, "r1": "x", "r2": "x"}


def test_cutoffs(records):
    p = prot("p", "M", hit("A", ok=None), hit("B", ok=None, dom_score=10.0), hit("C", ok=None, e=1e-3), hit("D", ok=None, hmm_to=49))
    df = records({"sequence": "A", "proteins": [p]})
    got = df.select(F.explode(M.passing(F.col("proteins")[0]["hmm_hits"], {"B": 20.0, "C": 40.0})).alias("h")).select("h.target", "h.passing").collect()
    assert {r.target: r.passing for r in got} == {"A": True, "B": False, "C": True, "D": False}


def test_report_cells(records):
    df = records({"sequence": "A", "proteins": [prot("p", "M", hit("A"), hit("B", ok=False))]}, {"sequence": "A", "proteins": []})
    rows = reports.proteins_long(df, ["id"])
    assert [r.protein_id for r in rows.collect()] == ["p"]
    assert rows.select(reports.hit_cell(F.col("hmm_hits"))).first()[0] == "A(E=1.0e-20,cov=1.00)"
    hits = rows.select("id", F.explode("hmm_hits").alias("h")).select("id", "h.*")
    assert {(r.id, r.target, r.dom_evalue) for r in reports.hit_grid(df, ["A", "Z"], hits).collect()} == {("r0", "A", 1e-20), ("r0", "Z", None), ("r1", "A", None), ("r1", "Z", None)}


SPEC = [P.Peptide("a", ("A",)), P.Peptide("b", ("B",), "LQ"), P.Peptide("c", ("C",))]


@pytest.mark.parametrize(("strategy", "spans", "want"), [
    ("boundary", [(5, 10), None, (30, 45)], [(5, 10, "boundary"), None, (30, 40, "boundary")]),
    ("bisect", [(5, 10), (15, 20), (31, 38)], [(1, 11, "n-term"), (12, 25, "bisect"), (26, 40, "bisect")]),
    ("bisect", [(5, 10), None, (31, 38)], [(1, 10, "n-term"), None, (31, 40, "hit-boundary")]),
    ("bisect", [None, (15, 20), (31, 38)], [None, (15, 25, "hit-boundary"), (26, 40, "bisect")]),
    ("bisect", [(5, 20), (11, 30), (31, 38)], [(1, 15, "n-term"), (16, 29, "bisect"), (30, 40, "bisect")]),
    ("bisect", [(15, 20), (5, 10), None], [None, None, None])])
def test_cuts(strategy, spans, want):
    assert P.cuts("A" * 40, P.Polyprotein(SPEC, strategy), spans) == want


def test_motif_snaps_to_the_last_in_the_window():
    body = "A" * 8 + "LQ" + "A" * 4 + "LQ" + "A" * 24
    assert P.snap(body, 12, "LQ", 5) == 17 and P.snap(body, 12, "LQ", 1) is None and P.snap(body, 12, None, 5) is None
    assert P.cuts(body, P.Polyprotein(SPEC, "motif", 5), [(1, 10), (15, 20), None])[1] == (17, 20, "motif:LQ")


def test_parent_and_slices(spark, records):
    body = "M" * 60
    p = prot("poly", body, hit("A", 1, 10), hit("B", 20, 30), hit("C", 40, 50))
    assert P.parent([prot("x", body, hit("A", 20, 30), hit("B", 1, 10)), p], P.Polyprotein(SPEC))["protein_id"] == "poly"
    assert P.parent([prot("x", body, hit("A"))], P.Polyprotein(SPEC)) is None
    spark.udtf.register("slice_all", P.slicer(P.Polyprotein(SPEC)))
    df = records({"sequence": "A", "proteins": [p]}, {"sequence": "A", "proteins": None})
    df.createOrReplaceTempView("poly_records")
    got = spark.sql("SELECT s.* FROM poly_records r, LATERAL slice_all(r.id, r.proteins) s").collect()
    assert "".join(r.sequence for r in got if r.id == "r0") == body
    assert {r.method for r in got if r.id == "r1"} == {"no_parent"} and len(got) == 6
