"""Alignments and trees as tables.

An alignment is (id, row); a tree is nodes (tree, node_id, parent_id, depth, support, leaves array). Readers of the
files are below; measures are DataFrame code, taxonomy review and labels are per tree.
"""

from __future__ import annotations

import re
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bind import known_join

#: Residue backgrounds (proteins: BLOSUM62).
NUCLEOTIDE_BG = {"A": 0.25, "C": 0.25, "G": 0.25, "T": 0.25}
PROTEIN_BG = {
    "A": 0.078, "R": 0.051, "N": 0.041, "D": 0.052, "C": 0.024, "Q": 0.034, "E": 0.059, "G": 0.083, "H": 0.025, "I": 0.062,
    "L": 0.092, "K": 0.056, "M": 0.024, "F": 0.044, "P": 0.043, "S": 0.059, "T": 0.055, "W": 0.014, "Y": 0.034, "V": 0.072,
}
NODE = "tree string, node_id int, parent_id int, depth int, support double, leaf string"


def _padded(msa: DataFrame, width: int | None = None) -> DataFrame:
    """``msa`` in upper case without empty rows; short rows are filled with gaps."""
    n = width or msa.agg(F.max(F.length("row"))).first()[0] or 0
    return msa.where(F.length("row") > 0).withColumn("row", F.rpad(F.upper("row"), n, "-"))


def _cells(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, F.posexplode(F.split("row", "")).alias("col", "ch")).where(F.col("ch") != "")


def columns(msa: DataFrame, width: int | None = None) -> DataFrame:
    """(id, col, ch) of an alignment; short rows are filled with gaps."""
    return _cells(_padded(msa, width), "id")


def henikoff(cols: DataFrame) -> DataFrame:
    """(id, w): position-based sequence weights, 1 in all; a gap is a symbol."""
    n = cols.groupBy("col", "ch").agg(F.count("*").alias("n"))
    k = n.groupBy("col").agg(F.count("*").alias("k"))
    w = cols.join(n, ["col", "ch"]).join(k, "col").groupBy("id").agg(F.sum(1.0 / (F.col("k") * F.col("n"))).alias("w"))
    total = w.agg(F.sum("w").alias("total"))  # one row
    return w.crossJoin(F.broadcast(total)).select("id", (F.col("w") / F.col("total")).alias("w"))


def conservation(msa: DataFrame, protein: bool | None = None) -> DataFrame:
    """(col, jsd, occupancy): divergence of each column from the background, and the weight of its residues.

    Equal rows weigh alike, so they are counted once, with their number. No join has cells on both sides or on the side that
    is broadcast: that is the table of symbols by column.
    """
    rows = _padded(msa).groupBy("row").agg(F.count("*").alias("m"))
    cells = _cells(rows, "row", "m")
    if protein is None:
        nt, total = cells.where(~F.col("ch").isin("-", ".", "~")).agg(F.sum(F.when(F.col("ch").isin(*"ACGTUN"), F.col("m"))), F.sum("m")).first()
        protein = not total or (nt or 0) / total < 0.9
    bg = PROTEIN_BG if protein else NUCLEOTIDE_BG
    bg = {k: v / sum(bg.values()) for k, v in bg.items()}
    ch = F.col("ch") if protein else F.when(F.col("ch") == "U", "T").otherwise(F.col("ch"))
    # position-based weights as in ``henikoff``
    n = cells.groupBy("col", "ch").agg(F.sum("m").alias("n"))
    share = n.join(n.groupBy("col").agg(F.count("*").alias("k")), "col").select("col", "ch", (1.0 / (F.col("k") * F.col("n"))).alias("share"))
    weighed = cells.join(F.broadcast(share), ["col", "ch"]).groupBy("row", "m").agg((F.sum("share") * F.col("m")).alias("w"))
    total = weighed.agg(F.sum("w").alias("total"))  # one row
    weighed = weighed.crossJoin(F.broadcast(total)).withColumn("w", F.col("w") / F.col("total"))
    p = _cells(weighed, "w").withColumn("ch", ch).withColumn("ch", F.when(F.col("ch").isin(*bg), F.col("ch"))).groupBy("col", "ch").agg(F.sum("w").alias("w"))
    # a column's residues are a map of at most the alphabet
    known = F.col("ch").isNotNull()
    both = p.groupBy("col").agg(F.map_from_entries(F.collect_list(F.when(known, F.struct("ch", "w")))).alias("of"), F.sum(F.when(known, F.col("w"))).alias("occupancy"))

    def part(x: Column) -> Column:
        own = F.coalesce(F.try_element_at("of", x["ch"]) / F.col("occupancy"), F.lit(0.0))
        m = (own + x["q"]) / 2
        return F.when(own > 0, own * F.log2(own / m)).otherwise(0.0) + x["q"] * F.log2(x["q"] / m)

    alphabet = F.array(*(F.struct(F.lit(k).alias("ch"), F.lit(v).alias("q")) for k, v in bg.items()))
    jsd = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.aggregate(F.transform(alphabet, part), F.lit(0.0), lambda a, v: a + v) / 2))
    return both.select("col", F.when(F.col("occupancy") > 0, jsd).otherwise(0.0).alias("jsd"), F.coalesce("occupancy", F.lit(0.0)).alias("occupancy"))


def conservation_score(per_column: DataFrame) -> DataFrame:
    """(n_sites, mean_conservation, mean_core): JSD by occupancy over all columns, and plain over half-filled ones."""
    return per_column.agg(F.count("*").alias("n_sites"), F.avg(F.col("jsd") * F.col("occupancy")).alias("mean_conservation"), F.avg(F.when(F.col("occupancy") >= 0.5, F.col("jsd"))).alias("mean_core"))


def supermatrix(parts: DataFrame) -> DataFrame:
    """(id, row, n_parts) of partitions (part, id, row): joined in order of parts, gaps where an id lacks one."""
    width = parts.groupBy("part").agg(F.max(F.length("row")).alias("w"))
    # the widths are one row, an array of all partitions; each id's own are put into it
    widths = width.agg(F.array_sort(F.collect_list(F.struct("part", "w"))).alias("widths"))
    own = parts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("part", "row"))).alias("own"), F.count("row").alias("n_parts"))
    cell = lambda x: F.coalesce(F.col("own")[x["part"]], F.repeat(F.lit("-"), x["w"].cast("int")))
    return own.crossJoin(F.broadcast(widths)).select("id", F.array_join(F.transform("widths", cell), "").alias("row"), "n_parts")


def partition_ranges(parts: DataFrame) -> DataFrame:
    """(part, start, stop): places of partitions in the supermatrix, from 1."""
    width = parts.groupBy("part").agg(F.max(F.length("row")).alias("w"))
    stop = F.sum("w").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    return width.select("part", (stop - F.col("w") + 1).alias("start"), stop.alias("stop"))


def rf_distances(clades: DataFrame) -> DataFrame:
    """(tree_a, tree_b, rf, norm_rf, n_common) of every pair of trees: (tree, leaves) of clades, the whole leaf set among them.

    Bipartitions are cut down to common leaves and named by the side without the least one.
    """
    trees = clades.groupBy("tree").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("leaves")))).alias("taxa"), F.collect_list("leaves").alias("clades"))
    a, b = (trees.select(*(F.col(c).alias(f"{c}_{s}") for c in trees.columns)) for s in "ab")
    pairs = a.join(b, F.col("tree_a") < F.col("tree_b")).withColumn("common", F.array_sort(F.array_intersect("taxa_a", "taxa_b")))
    n = F.size("common")

    def splits(c: str) -> Column:
        side = F.transform(c, lambda x: F.array_sort(F.array_intersect(x, F.col("common"))))
        able = F.filter(side, lambda x: (F.size(x) >= 2) & (F.size(x) <= n - 2))
        return F.array_distinct(F.transform(able, lambda x: F.array_join(F.when(F.array_contains(x, F.element_at("common", 1)), F.array_except(F.col("common"), x)).otherwise(x), "\x1f")))

    pairs = pairs.withColumn("sa", splits("clades_a")).withColumn("sb", splits("clades_b"))
    rf = F.size(F.array_except("sa", "sb")) + F.size(F.array_except("sb", "sa"))
    norm = F.when(n >= 4, rf / (2.0 * (n - 3)))
    return pairs.select("tree_a", "tree_b", F.when(n > 0, rf).otherwise(0).alias("rf"), norm.alias("norm_rf"), n.alias("n_common"))


def monophyly(nodes: DataFrame, labels: DataFrame, supported: bool = False) -> DataFrame:
    """(tree, rank, taxon, n_leaves, status, n_clusters, n_intruders, intruder_clusters, intruder_taxa) for taxa of two leaves or more.

    ``nodes``: tree, node_id, parent_id, leaves; ``labels``: leaf, rank, taxon. Leaves without a label at a rank count for nothing
    there. A taxon is monophyletic if no other stands in the smallest node over it, or with ``supported`` (weak branches collapsed
    before) if no node overlaps it without holding or being held. One outside block makes it paraphyletic, more polyphyletic.
    """
    key = ["tree", "rank", "taxon"]
    labels = labels.where("taxon is not null")
    leaf = nodes.select("tree", "node_id", "parent_id", F.size("leaves").alias("size"), F.explode("leaves").alias("leaf"))
    # all from counts of each taxon under each node: leaf sets are never compared
    per = leaf.join(labels, "leaf").groupBy("tree", "rank", "node_id", "parent_id", "size", "taxon").agg(F.count("*").alias("c"))
    node = per.groupBy("tree", "rank", "node_id", "parent_id").agg(F.sum("c").alias("all"))
    per = per.join(node.drop("parent_id"), ["tree", "rank", "node_id"])
    total = per.groupBy(*key).agg(F.max("c").alias("n")).where("n >= 2")
    x = per.join(total, key)
    span = x.groupBy(*key).agg(
        F.max("n").alias("n"), F.min(F.when(F.col("c") == F.col("n"), F.struct("size", "node_id", "all"))).alias("m"),
        F.max((F.col("c") < F.col("n")) & (F.col("all") > F.col("c"))).alias("clash"),
    )
    up = x.select(*key, F.col("node_id").alias("parent_id"), (F.col("all") == F.col("c")).alias("pure_above"))
    own = x.where(F.col("all") == F.col("c")).join(up, [*key, "parent_id"], "left").where(~F.coalesce("pure_above", F.lit(False))).groupBy(*key).agg(F.count("*").alias("own"))
    # an outside block: a labelled node without members right below one with members, inside the span
    inside = x.join(span.select(*key, "m"), key).where(F.col("size") <= F.col("m.size")).select(*key, F.col("node_id").alias("parent_id"))
    below = inside.join(node.select("tree", "rank", "parent_id", "node_id"), ["tree", "rank", "parent_id"])
    other = below.join(x.select(*key, "node_id"), [*key, "node_id"], "left_anti").groupBy(*key).agg(F.count("*").alias("other"))
    who = span.select(*key, F.col("m.node_id").alias("node_id")).join(per.select("tree", "rank", "node_id", F.col("taxon").alias("who")), ["tree", "rank", "node_id"]).where("who <> taxon")
    names = who.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("who")), ";").alias("names"))
    got = span.join(own, key, "left").join(other, key, "left").join(names, key, "left").withColumn("intruders", F.col("m.all") - F.col("n"))
    got = got.withColumn("good", ~F.col("clash") if supported else F.col("intruders") == 0)
    zero = F.lit(0).cast("bigint")
    pick = lambda c, if_good: F.when(F.col("good"), if_good).otherwise(c)
    return got.select(
        *key, F.col("n").cast("int").alias("n_leaves"), F.when(F.col("good"), "monophyletic").when(F.col("other") == 1, "paraphyletic").otherwise("polyphyletic").alias("status"),
        pick(F.coalesce("own", zero), F.lit(1).cast("bigint")).alias("n_clusters"), pick(F.col("intruders"), zero).cast("int").alias("n_intruders"), pick(F.coalesce("other", zero), zero).alias("intruder_clusters"), pick(F.coalesce("names", F.lit("")), F.lit("")).alias("intruder_taxa"),
    )


def lca_label(lineages: DataFrame, least: float = 0.5) -> DataFrame:
    """(tree, node_id, rank, name, share): the finest (rank, name) that all labelled leaves of a node share.

    ``lineages``: tree, node_id, leaf, lineage array<struct<rank, name>> root to tip (null: no label). The share is of all leaves.
    """
    rows = lineages.groupBy("tree", "node_id").agg(F.count("*").alias("n"), F.count("lineage").alias("labelled"), F.min_by("lineage", F.size("lineage")).alias("first"), F.collect_set("lineage").alias("all"))
    same = lambda i: F.forall("all", lambda other: F.get(other, i) == F.get("first", i))
    # a prefix ends at the first place where one differs
    depth = F.size(F.filter(F.sequence(F.lit(1), F.size("first")), lambda k: F.forall(F.sequence(F.lit(0), k - 1), lambda i: same(i))))
    rows = rows.where(F.size("first") > 0).withColumn("depth", depth).withColumn("share", F.col("labelled") / F.col("n"))
    return rows.where((F.col("depth") > 0) & (F.col("share") >= least)).select("tree", "node_id", F.element_at("first", F.col("depth"))["rank"].alias("rank"), F.element_at("first", F.col("depth"))["name"].alias("name"), "share")


def clear_nested(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Labels less those that an ancestor has too. ``nodes``: tree, node_id, leaves."""
    named = labels.join(nodes.select("tree", "node_id", "leaves"), ["tree", "node_id"])
    up = named.select("tree", "name", F.col("node_id").alias("upper"), F.col("leaves").alias("over"))
    inside = named.join(up, ["tree", "name"]).where((F.col("upper") != F.col("node_id")) & (F.size(F.array_except("leaves", "over")) == 0) & (F.size("over") > F.size("leaves")))
    return labels.join(inside.select("tree", "node_id").distinct(), ["tree", "node_id"], "left_anti")


def review(nodes: DataFrame, labels: DataFrame, rank: str, support: float = 90.0, purity: float = 0.9, least: int = 3) -> DataFrame:
    """(tree, leaf, own, value, share, action): a leaf's label against its smallest well-supported clade of ``least`` labelled others.

    `impute` where the leaf has none, `conflict` where it has another, and the others' commonest label has the share ``purity``.
    """
    own = labels.where(F.col("rank") == rank).select("leaf", "taxon")
    clades = nodes.where((F.col("support") >= support) & (F.size("leaves") >= 2)).select("tree", "node_id", "leaves", F.size("leaves").alias("size"))
    pair = clades.select("tree", "node_id", "size", F.explode("leaves").alias("leaf"), "leaves").select("tree", "node_id", "size", "leaf", F.explode("leaves").alias("other")).where("leaf <> other")
    votes = pair.join(own.withColumnRenamed("leaf", "other"), "other").groupBy("tree", "leaf", "node_id", "size", "taxon").agg(F.count("*").alias("n"))
    per = votes.groupBy("tree", "leaf", "node_id", "size").agg(F.sum("n").alias("all"), F.max(F.struct("n", F.col("taxon"))).alias("top")).where(F.col("all") >= least)
    best = per.groupBy("tree", "leaf").agg(F.min(F.struct("size", "node_id", "all", "top")).alias("b"))
    out = best.join(own, "leaf", "left").select("tree", "leaf", F.col("taxon").alias("own"), F.col("b.top.taxon").alias("value"), (F.col("b.top.n") / F.col("b.all")).alias("share"))
    action = F.when(F.col("own").isNull(), "impute").when(F.col("own") != F.col("value"), "conflict")
    return out.withColumn("action", action).where((F.col("share") >= purity) & F.col("action").isNotNull())


def collapse_weak(rows: list[tuple], support: float) -> list[tuple]:
    """Node rows without inner nodes below a support; their children go to the next strong node up."""
    by = {r[1]: r for r in rows}
    inner = {r[2] for r in rows}
    weak = {r[1] for r in rows if r[1] in inner and r[2] is not None and r[4] is not None and r[4] < support}

    def up(k: int | None) -> int | None:
        while k in weak:
            k = by[k][2]
        return k

    return [(r[0], r[1], up(r[2]), *r[3:]) for r in rows if r[1] not in weak]


def parse_newick(tree: str, text: str, names: dict[str, str] | None = None) -> list[tuple]:
    """NODE rows of a Newick string, each with its branch length behind; inner labels that are numbers are supports; ``names`` renames leaves."""
    rows: list[list] = [[tree, 0, None, 0, None, None, None]]
    at, opened = 0, []
    for tok in re.findall(r"[(),;]|'[^']*'(?::[^,();]*)?|[^(),;\s]+", text):
        if tok == "(":
            opened.append(at)
            rows.append([tree, len(rows), at, len(opened), None, None, None])
            at = len(rows) - 1
        elif tok == ",":
            rows.append([tree, len(rows), opened[-1], len(opened), None, None, None])
            at = len(rows) - 1
        elif tok == ")":
            at = opened.pop()
        elif tok != ";":
            name = re.fullmatch(r"('[^']*'|[^:]*)(?::(.*))?", tok)
            label = name[1].strip("'")
            rows[at][6] = float(name[2]) if name[2] else None
            if any(r[2] == at for r in rows):
                rows[at][4] = float(label) if re.fullmatch(r"\d+(\.\d+)?", label) else None
            elif label:
                rows[at][5] = (names or {}).get(label, label)
    return [tuple(r) for r in rows]


def parse_phyloxml(tree: str, text: str) -> tuple[list[tuple], list[tuple]]:
    """(NODE rows, (leaf, rank, taxon) rows) of a phyloXML document."""
    tag = lambda e: e.tag.rpartition("}")[2]
    rows, labels = [], []

    def visit(e, parent: int | None, depth: int) -> None:
        k = len(rows)
        kids = [c for c in e if tag(c) == "clade"]
        name = next((c.text for c in e if tag(c) == "name"), None)
        support = next((float(c.text) for c in e if tag(c) == "confidence" and c.text), None)
        rows.append((tree, k, parent, depth, support, None if kids else name))
        for c in e if not kids else ():
            ref = c.get("ref", "") if tag(c) == "property" else ""
            if ref and c.text:
                labels.append((name, ref.rpartition(":")[2], c.text))
        for c in kids:
            visit(c, k, depth + 1)

    root = ElementTree.fromstring(text)
    visit(next(c for c in root.iter() if tag(c) == "clade"), None, 0)
    return rows, labels


XML = "tree string, xml string"


def phyloxml(nodes: DataFrame, labels: DataFrame | None = None, rooted: bool = True) -> DataFrame:
    """(tree, xml): each tree as a phyloXML document that ``parse_phyloxml`` reads again; children in the order of their numbers.

    ``nodes``: tree, node_id, parent_id, support, leaf (null inside), and length and label (a name for an inner node) if there
    are; ``labels``: leaf, rank, taxon, as properties of leaves. One tree is made in one task.
    """
    extra = {"length": "double", "label": "string"}
    rows = nodes.select("tree", "node_id", "parent_id", "support", "leaf", *(F.col(c) if c in nodes.columns else F.lit(None).cast(k).alias(c) for c, k in extra.items()))
    if labels is None:
        rows = rows.withColumn("props", F.lit(None).cast("array<string>"))
    else:  # rank and value, a pair after the other
        props = labels.where("taxon is not null").groupBy("leaf").agg(F.flatten(F.transform(F.array_sort(F.collect_set(F.struct("rank", "taxon"))), lambda x: F.array(x["rank"], x["taxon"]))).alias("props"))
        rows = known_join(rows, props, "leaf")

    def one(pdf):
        kids: dict[int | None, list[int]] = {}
        by = {}
        for r in pdf.sort_values("node_id").itertuples():
            by[r.node_id] = r
            kids.setdefault(None if r.parent_id is None or r.parent_id != r.parent_id else int(r.parent_id), []).append(r.node_id)
        given = lambda v: v is not None and v == v
        esc = lambda v: escape(str(v))
        out, stack = [], [(k, False) for k in reversed(kids.get(None, []))]
        while stack:
            k, done = stack.pop()
            if done:
                out.append("</clade>")
                continue
            r = by[k]
            out.append("<clade>")
            name = r.leaf if given(r.leaf) else r.label
            if given(name):
                out.append(f"<name>{esc(name)}</name>")
            if given(r.length):
                out.append(f"<branch_length>{float(r.length)!r}</branch_length>")
            if given(r.support):
                out.append(f'<confidence type="support">{float(r.support)!r}</confidence>')
            pairs = [] if r.props is None or isinstance(r.props, float) else list(r.props)
            out += [f'<property ref="rank:{esc(a)}" datatype="xsd:string" applies_to="node">{esc(b)}</property>' for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
            stack += [(k, True), *((c, False) for c in reversed(kids.get(k, [])))]
        tree = pdf["tree"].iat[0]
        head = f'<phyloxml xmlns="http://www.phyloxml.org"><phylogeny rooted="{str(rooted).lower()}"><name>{esc(tree)}</name>'
        return pd.DataFrame({"tree": [tree], "xml": [head + "".join(out) + "</phylogeny></phyloxml>"]})

    return rows.groupBy("tree").applyInPandas(one, XML)


def node_table(spark: SparkSession, rows: list[tuple], support: float = 0) -> DataFrame:
    """Nodes with their leaf sets, weak branches collapsed if asked."""
    rows = collapse_weak(rows, support) if support else rows
    parent = {(r[0], r[1]): r[2] for r in rows}
    leaves: dict[tuple, list[str]] = {(r[0], r[1]): [] for r in rows}
    for r in rows:
        if r[5] is not None:
            k = r[1]
            while k is not None:
                leaves[r[0], k].append(r[5])
                k = parent[r[0], k]
    return spark.createDataFrame([(*r[:5], sorted(leaves[r[0], r[1]])) for r in rows], "tree string, node_id int, parent_id int, depth int, support double, leaves array<string>")


def read_msa(spark: SparkSession, path: str) -> DataFrame:
    """(id, row): FASTA by the first word of the header, gaps kept."""
    text = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    whole = F.regexp_replace("value", "^>", "")
    return text.select(F.regexp_extract(whole, r"^(\S+)", 1).alias("id"), F.upper(F.regexp_replace(F.regexp_replace(whole, r"^[^\r\n]*[\r\n]*", ""), r"\s", "")).alias("row"))
