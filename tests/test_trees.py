import math

import pytest
from pyspark.sql import functions as F

from seqpick.operators import reports, trees


def msa(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "id int, row string")


def test_weights_sum_to_one_and_favour_the_odd_row(spark):
    w = {r.id: r.w for r in trees.henikoff(trees.columns(msa(spark, "AAAA", "AAAA", "TTTT"))).collect()}
    assert math.isclose(sum(w.values()), 1) and w[2] > w[0] == w[1]


def test_conservation_bounds(spark):
    one = trees.conservation_score(trees.conservation(msa(spark, "WWWW", "WWWW"), protein=True)).first()
    mixed = trees.conservation_score(trees.conservation(msa(spark, "WAKL", "LKAW", "----"), protein=True)).first()
    assert 0.7 < one.mean_conservation < 1 and mixed.mean_conservation < one.mean_conservation and one.n_sites == 4
    gaps = trees.conservation(msa(spark, "A-", "C-"), protein=False).orderBy("col").collect()
    assert gaps[1].jsd == 0 and gaps[1].occupancy == 0
    rna = trees.conservation(msa(spark, "ACGU", "ACGU")).collect()
    assert all(r.occupancy == pytest.approx(1) for r in rna)


def test_conservation_counts_equal_rows_once_and_broadcasts_no_cells(spark):
    """Equal rows weigh as so many rows; a join over cells has a hint, so that no estimate of sizes broadcasts them."""
    rows = ["WAKL"] * 5 + ["LKAW"] * 3 + ["wa", "", None, "----"]
    got = trees.conservation(msa(spark, *rows), protein=True)
    kids = lambda node: [node.children().apply(i) for i in range(node.children().size())]
    cells = lambda node: node.nodeName() == "Generate" or node.nodeName() != "Aggregate" and any(map(cells, kids(node)))
    todo = [got._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        todo += kids(node)
        if node.nodeName() == "Join" and any(map(cells, kids(node))):
            assert "broadcast" in node.hint().toString() and not cells(kids(node)[1])
    weights = {r.id: r.w for r in trees.henikoff(trees.columns(msa(spark, *rows))).collect()}
    full = [(weights[i], (r.upper() + "----")[:4]) for i, r in enumerate(rows) if r]
    for r in got.collect():
        assert r.occupancy == pytest.approx(sum(w for w, s in full if s[r["col"]] != "-"))
        q = {k: v / sum(trees.PROTEIN_BG.values()) for k, v in trees.PROTEIN_BG.items()}
        p = {k: sum(w for w, s in full if s[r["col"]] == k) / r.occupancy for k in q}
        assert r.jsd == pytest.approx(sum((p[k] * math.log2(2 * p[k] / (p[k] + q[k])) if p[k] else 0) + q[k] * math.log2(2 * q[k] / (p[k] + q[k])) for k in q) / 2)


def test_supermatrix_fills_gaps(spark):
    parts = spark.createDataFrame([(1, "a", "AC"), (1, "b", "GT"), (2, "a", "TTT")], "part int, id string, row string")
    assert {r.id: (r.row, r.n_parts) for r in trees.supermatrix(parts).collect()} == {"a": ("ACTTT", 2), "b": ("GT---", 1)}
    assert [(r.start, r.stop) for r in trees.partition_ranges(parts).orderBy("part").collect()] == [(1, 2), (3, 5)]


def rf(spark, **newick):
    rows = [r for t, s in newick.items() for r in trees.parse_newick(t, s)]
    r = trees.rf_distances(trees.node_table(spark, rows).select("tree", "leaves")).collect()
    return [(x.rf, x.norm_rf, x.n_common) for x in r]


def test_robinson_foulds(spark):
    assert rf(spark, a="((A,B),(C,D));", b="((A,B),(C,D));") == [(0, 0.0, 4)]
    assert rf(spark, a="((A,B),(C,D));", b="((A,C),(B,D));") == [(2, 1.0, 4)]
    assert rf(spark, a="((A,B),(C,D));", b="(((A,B),C),D);") == [(0, 0.0, 4)]  # a split and its mirror
    assert rf(spark, a="((A,B),C);", b="((A,C),B);") == [(0, None, 3)]
    assert rf(spark, a="(A,B);", b="(C,D);") == [(0, None, 0)]


def status(spark, newick, labels, support=0):
    nodes = trees.node_table(spark, trees.parse_newick("t", newick), support)
    lab = spark.createDataFrame([(k, "genus", v) for k, v in labels.items()], "leaf string, rank string, taxon string")
    return {r.taxon: (r.status, r.n_clusters, r.n_intruders, r.intruder_clusters, r.intruder_taxa) for r in trees.monophyly(nodes, lab, bool(support)).collect()}


def test_monophyly(spark):
    got = status(spark, "(((A1,A2),B1),(B2,C1));", {"A1": "A", "A2": "A", "B1": "B", "B2": "B", "C1": "C"})
    assert got["A"] == ("monophyletic", 1, 0, 0, "") and got["B"] == ("polyphyletic", 2, 3, 2, "A;C") and "C" not in got
    got = status(spark, "((A1,(A2,(B1,B2))),C1);", {"A1": "A", "A2": "A", "B1": "B", "B2": "B", "C1": "C"})
    assert got["A"] == ("paraphyletic", 2, 2, 1, "B")


def test_unlabelled_leaves_are_no_intruders(spark):
    assert status(spark, "((A1,(x,A2)),B1);", {"A1": "A", "A2": "A", "B1": "B", "x": None})["A"][0] == "monophyletic"


def test_weak_branches_are_collapsed(spark):
    tree = "((A1,B1)40,(A2,C1)95)100;"
    assert status(spark, tree, {"A1": "A", "A2": "A", "B1": "B", "C1": "C"}, 70)["A"][0] != "monophyletic"
    assert status(spark, "((A1,B1)40,A2,C1)100;", {"A1": "A", "A2": "A", "B1": "B", "C1": "C"}, 70)["A"][0] == "monophyletic"


def test_newick_names_and_support(spark):
    rows = trees.parse_newick("t", "(('a b':0.1,c:0.2)90:1,d);", {"c": "see"})
    assert sorted(r[5] for r in rows if r[5]) == ["a b", "d", "see"] and [r[4] for r in rows if r[4]] == [90.0]


def test_phyloxml():
    rows, labels = trees.parse_phyloxml("t", '<phyloxml xmlns="http://www.phyloxml.org"><phylogeny><clade><confidence>80</confidence><clade><name>a</name><property ref="x:genus">G</property></clade><clade><name>b</name></clade></clade></phylogeny></phyloxml>')
    assert [r[5] for r in rows] == [None, "a", "b"] and rows[0][4] == 80 and labels == [("a", "genus", "G")]


def test_lca_and_nested_labels(spark):
    lin = lambda *x: [(r, n) for r, n in zip(("family", "genus", "species"), x, strict=False)]
    rows = [("t", 0, "a", lin("F", "G", "s1")), ("t", 0, "b", lin("F", "G", "s2")), ("t", 0, "c", None), ("t", 1, "a", lin("F", "G", "s1")), ("t", 1, "b", lin("F", "G", "s2")), ("t", 2, "c", None), ("t", 2, "d", None), ("t", 2, "e", lin("F"))]
    df = spark.createDataFrame(rows, "tree string, node_id int, leaf string, lineage array<struct<rank:string,name:string>>")
    got = trees.lca_label(df)
    assert {(r.node_id, r["rank"], r.name) for r in got.collect()} == {(0, "genus", "G"), (1, "genus", "G")}
    nodes = spark.createDataFrame([("t", 0, ["a", "b", "c"]), ("t", 1, ["a", "b"])], "tree string, node_id int, leaves array<string>")
    assert [r.node_id for r in trees.clear_nested(got, nodes).collect()] == [0]


def test_review(spark):
    nodes = trees.node_table(spark, trees.parse_newick("t", "((a,b,c,d)95,(e,f)99)100;"))
    lab = spark.createDataFrame([("a", "genus", "G"), ("b", "genus", "G"), ("c", "genus", "G"), ("e", "genus", "G"), ("f", "genus", "H")], "leaf string, rank string, taxon string")
    got = {r.leaf: (r.value, r.action) for r in trees.review(nodes, lab, "genus", purity=0.7).collect()}
    assert got == {"d": ("G", "impute"), "f": ("G", "conflict")}


def test_segment_status(spark):
    rows = spark.createDataFrame([("g", "A", "t1", "monophyletic"), ("g", "A", "t2", "polyphyletic"), ("g", "B", "t1", "monophyletic")], "rank string, taxon string, tree string, status string")
    assert {r.taxon: (r.n_trees, r.n_broken, r.broken, r.single_break) for r in reports.segment_status(rows).collect()} == {"A": (2, 1, "t2", True), "B": (1, 0, "", False)}


def test_alarms(spark):
    d = spark.createDataFrame([("x", 1)], "subject string, detail int")
    assert {(r.alarm, r.subject, r.detail) for r in reports.alarms(wall=d, loss=d).collect()} == {("wall", "x", "1"), ("loss", "x", "1")}


def test_read_msa(spark, tmp_path):
    (tmp_path / "m.fa").write_text(">a one\nAC-\ngt\n>b\n-----\n")
    assert {r.id: r.row for r in trees.read_msa(spark, str(tmp_path / "m.fa")).collect()} == {"a": "AC-GT", "b": "-----"}
    assert trees.columns(trees.read_msa(spark, str(tmp_path / "m.fa"))).where(F.col("ch") == "-").count() == 6
