"""Where a tree's root goes: by an outgroup, by taxonomy, by least ancestor deviation, or at the midpoint.

A root is a place on a branch of the unrooted tree, so the tree is held as its branches: supports and lengths belong to
them and stay with them. One tree fits a task (``root_all`` is a grouped map over many).
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

METHODS = ("auto", "outgroup", "taxonomy", "mad", "midpoint", "none")


class Unrooted:
    """Branches of a tree from NODE rows with lengths: (tree, node, parent, depth, support, leaf, length)."""

    def __init__(self, rows: list[tuple]):
        self.tree = rows[0][0]
        self.leaf = {r[1]: r[5] for r in rows if r[5] is not None}
        self.near: dict[int, dict[int, tuple[float, float | None]]] = defaultdict(dict)
        for r in rows:
            if r[2] is not None:
                self.near[r[1]][r[2]] = self.near[r[2]][r[1]] = (r[6] or 0.0, r[4])
        for k in [k for k, v in self.near.items() if len(v) == 2 and k not in self.leaf]:
            # a root of two branches is one branch
            (a, (la, sa)), (b, (lb, sb)) = self.near.pop(k).items()
            del self.near[a][k], self.near[b][k]
            self.near[a][b] = self.near[b][a] = (la + lb, max((s for s in (sa, sb) if s is not None), default=None))

    def branches(self) -> list[tuple[int, int, float]]:
        return [(a, b, v[0]) for a, n in self.near.items() for b, v in n.items() if a < b]

    def side(self, a: int, b: int) -> set[str]:
        """Leaves on ``b``'s side of the branch a - b."""
        out, todo = set(), [(a, b)]
        while todo:
            up, k = todo.pop()
            if k in self.leaf:
                out.add(self.leaf[k])
            todo += [(k, n) for n in self.near[k] if n != up]
        return out

    def distances(self, start: int) -> dict[int, float]:
        out, todo = {start: 0.0}, [start]
        while todo:
            k = todo.pop()
            for n, (length, _) in self.near[k].items():
                if n not in out:
                    out[n] = out[k] + length
                    todo.append(n)
        return out

    def rooted(self, a: int, b: int, x: float) -> list[tuple]:
        """NODE rows with the root on the branch a - b, ``x`` from b."""
        length, support = self.near[a][b]
        root = max(self.near) + 1
        rows = [(self.tree, root, None, 0, None, None, None)]
        todo = [(root, a, b, 1, length - x, support), (root, b, a, 1, x, support)]
        while todo:
            parent, k, not_to, depth, here, s = todo.pop()
            rows.append((self.tree, k, parent, depth, None if k in self.leaf else s, self.leaf.get(k), here))
            todo += [(k, n, k, depth + 1, *v) for n, v in self.near[k].items() if n != not_to]
        return rows


def by_outgroup(t: Unrooted, outgroup: set[str]) -> tuple[int, int, float] | None:
    """The branch whose one side holds the whole outgroup and the fewest others; None if it is nobody or everybody."""
    every = set(t.leaf.values())
    wanted = outgroup & every
    if not wanted or wanted == every:
        return None
    sides = [(len(s - wanted), a, b, length) for x, y, length in t.branches() for a, b in ((x, y), (y, x)) if wanted <= (s := t.side(a, b)) and s != every]
    _, a, b, length = min(sides)
    return a, b, length / 2


def specificity(rows: list[tuple], lineage: dict[str, list[str]], coverage: float = 0.5) -> float:
    """How deep the common lineage of each inner node's leaves is on average, weighted by leaves."""
    kids, leaf = defaultdict(list), {r[1]: r[5] for r in rows}
    for r in rows:
        kids[r[2]].append(r[1])
    total = weight = 0

    def under(k: int) -> list[str]:
        nonlocal total, weight
        if k not in kids:
            return [leaf[k]]
        got = [x for c in kids[k] for x in under(c)]
        known = [lineage[x] for x in got if lineage.get(x)]
        if known and len(known) / len(got) >= coverage:
            total += len(got) * next((i for i, step in enumerate(zip(*known, strict=False)) if len(set(step)) > 1), min(map(len, known)))
            weight += len(got)
        return got

    under(kids[None][0])
    return total / weight if weight else 0.0


def by_taxonomy(t: Unrooted, lineage: dict[str, list[str]]) -> tuple[int, int, float] | None:
    """The branch that makes clades agree with lineages best; of equals the shortest."""
    if not any(lineage.values()):
        return None
    best = max(((specificity(t.rooted(a, b, length / 2), lineage), -length, -a, -b) for a, b, length in t.branches()), default=None)
    return best and (-best[2], -best[3], -best[1] / 2)


def by_deviation(t: Unrooted) -> tuple[int, int, float] | None:
    """The place where the two halves of each leaf pair's path differ least, relative to the path (in squares)."""
    nodes = sorted(t.leaf)
    if len(nodes) < 3:
        return None
    to = {k: t.distances(k) for k in nodes}
    pair = np.array([[to[i][j] for j in nodes] for i in nodes])
    upper = np.triu(pair > 0, 1)
    inverse = np.where(pair > 0, 1 / np.where(pair > 0, pair, 1) ** 2, 0)
    best = None
    for a, b, length in t.branches():
        if length <= 0:
            continue
        below = np.array([t.leaf[k] in s for k in nodes]) if (s := t.side(a, b)) else None
        d = np.array([to[k][b] for k in nodes])
        diff = d[:, None] - d[None]
        cross = below[:, None] != below[None]
        same = (diff**2 * inverse)[upper & ~cross].sum()
        # below minus above, plus twice the root's way from b, over the path
        num, inv = np.where(below[:, None], diff, -diff)[upper & cross], inverse[upper & cross]
        q, lin, const = 4 * inv.sum(), (4 * num * inv).sum(), (num**2 * inv).sum()
        x = float(np.clip(-lin / (2 * q), 0, length)) if q else 0.0
        score = q * x * x + lin * x + const + same
        if best is None or score < best[0] - 1e-12:
            best = (score, a, b, x)
    return best and best[1:]


def at_midpoint(t: Unrooted) -> tuple[int, int, float] | None:
    """The middle of the longest path between leaves."""
    nodes = sorted(t.leaf)
    if len(nodes) < 2:
        return None
    start = max(t.distances(nodes[0]).items(), key=lambda v: (v[0] in t.leaf, v[1]))[0]
    d = t.distances(start)
    end = max(nodes, key=lambda k: d[k])
    half, k = d[end] / 2, end
    while True:
        up = min(t.near[k], key=lambda n: d[n])
        if d[up] <= half:
            return up, k, d[k] - half
        k = up


def root(rows: list[tuple], method: str = "auto", outgroup: set[str] | None = None, lineage: dict[str, list[str]] | None = None) -> tuple[list[tuple], str]:
    """(rows of the rooted tree, the method that placed it): what was asked for, else the next of the chain, the midpoint at last."""
    if method not in METHODS:
        method = "auto"
    t = Unrooted(rows)
    if method == "none" or len(t.leaf) < 2:
        return rows, "none"
    chain = [("outgroup", lambda: by_outgroup(t, outgroup or set()))] if method == "outgroup" else []
    chain += [("taxonomy", lambda: by_taxonomy(t, lineage or {}))] if method in ("auto", "taxonomy") else []
    chain += [("mad", lambda: by_deviation(t))] if method in ("auto", "mad") else []
    for name, place in [*chain, ("midpoint", lambda: at_midpoint(t))]:
        if got := place():
            return t.rooted(*got), name
    return rows, "none"


ROWS = "tree string, node_id int, parent_id int, depth int, support double, leaf string, length double, method string"


def root_all(nodes: DataFrame, method: str = "auto", outgroup: set[str] | None = None, lineage: dict[str, list[str]] | None = None) -> DataFrame:
    """Roots each tree of (tree, node_id, parent_id, depth, support, leaf, length): trees are independent groups."""
    names = ["tree", "node_id", "parent_id", "depth", "support", "leaf", "length"]

    def one(table: pa.Table) -> pa.Table:
        rows, used = root([tuple(r[n] for n in names) for r in table.select(names).to_pylist()], method, outgroup, lineage)
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.float64()]
        cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        return pa.Table.from_arrays([*cols, pa.array([used] * len(rows), pa.string())], names=[*names, "method"])

    return nodes.select(*names).groupBy("tree").applyInArrow(one, ROWS)
