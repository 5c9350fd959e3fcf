import pytest

from seqpick.operators import rooting as R
from seqpick.operators.trees import parse_newick


def clades(rows):
    """Leaf sets below the root's children."""
    kids, leaf = {}, {r[1]: r[5] for r in rows}
    for r in rows:
        kids.setdefault(r[2], []).append(r[1])

    def under(k):
        return {leaf[k]} if k not in kids else set().union(*map(under, kids[k]))

    return sorted(sorted(under(k)) for k in kids[kids[None][0]])


TREE = "((A:1,B:1)90:1,(C:1,D:1)80:1,E:5);"


def test_newick_lengths_and_branches():
    rows = parse_newick("t", TREE)
    assert sum(r[6] for r in rows if r[6]) == 11
    t = R.Unrooted(rows)
    assert len(t.branches()) == 7 and {t.leaf[k] for k in t.leaf} == set("ABCDE")
    assert len(R.Unrooted(parse_newick("t", "((A:1,B:1):1,(C:1,D:1):1);")).branches()) == 5


def test_outgroup_is_a_branch_of_the_unrooted_tree():
    got, used = R.root(parse_newick("t", TREE), "outgroup", {"A", "B"})
    assert used == "outgroup" and clades(got) == [["A", "B"], ["C", "D", "E"]]
    got, _ = R.root(parse_newick("t", TREE), "outgroup", {"A", "C"})
    assert ["E"] in clades(got) or any({"A", "C"} <= set(c) for c in clades(got))
    assert R.root(parse_newick("t", TREE), "outgroup", set("ABCDE"))[1] == "midpoint"
    assert R.root(parse_newick("t", TREE), "outgroup", {"zz"})[1] == "midpoint"


def test_midpoint():
    got, used = R.root(parse_newick("t", TREE), "midpoint")
    assert used == "midpoint" and clades(got) == [["A", "B", "C", "D"], ["E"]]
    root_kids = [r for r in got if r[3] == 1]
    assert sorted(r[6] for r in root_kids) == [1.5, 3.5]  # the longest path is 7


def test_deviation_finds_the_clock_root():
    # a clock tree: all tips 3 from the true root, written with another root
    got, used = R.root(parse_newick("t", "(A:1,B:1,((C:1,D:1):1,E:2):3);"), "mad")
    assert used == "mad" and clades(got) == [["A", "B"], ["C", "D", "E"]]
    assert sorted(round(r[6], 6) for r in got if r[3] == 1) == [1, 2]


def test_taxonomy_and_chain():
    rows = parse_newick("t", "(A:1,B:1,((C:1,D:1):1,E:1):1);")
    lineage = {"A": ["r", "x"], "B": ["r", "x"], "C": ["r", "y", "y1"], "D": ["r", "y", "y1"], "E": ["r", "y"]}
    got, used = R.root(rows, "auto", lineage=lineage)
    assert used == "taxonomy" and clades(got) == [["A", "B"], ["C", "D", "E"]]
    assert R.root(rows, "taxonomy")[1] == "midpoint" and R.root(rows, "auto")[1] == "mad" and R.root(rows, "none") == (rows, "none")


def test_supports_stay_on_their_branches():
    got, _ = R.root(parse_newick("t", TREE), "outgroup", {"E"})
    leaf = {r[1]: r[5] for r in got}
    under = {}
    for r in sorted(got, key=lambda r: -r[3]):
        under.setdefault(r[1], {leaf[r[1]]} - {None})
        if r[2] is not None:
            under.setdefault(r[2], set()).update(under[r[1]])
    assert {frozenset(under[r[1]]): r[4] for r in got if r[4]} == {frozenset("AB"): 90.0, frozenset("CD"): 80.0}


@pytest.mark.parametrize("text", ["A;", "(A,B);", "(A:0,B:0,C:0);"])
def test_small_and_flat_trees(text):
    for m in R.METHODS:
        rows, _ = R.root(parse_newick("t", text), m)
        assert {r[5] for r in rows if r[5]} == {c for c in "ABC" if c in text}


def test_root_all_trees_of_a_table(spark):
    rows = parse_newick("one", TREE) + parse_newick("two", "((A:1,B:1):1,C:4);")
    df = spark.createDataFrame(rows, "tree string, node_id int, parent_id int, depth int, support double, leaf string, length double")
    got = R.root_all(df, "midpoint").collect()
    for name, want in (("one", [["A", "B", "C", "D"], ["E"]]), ("two", [["A", "B"], ["C"]])):
        mine = [tuple(r)[:7] for r in got if r.tree == name]
        assert clades(mine) == want
