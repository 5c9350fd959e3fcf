"""Mature peptides: the parent protein, and where it is cut."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.functions import udtf

from .markers import TOLERANCE, parse_token


@dataclass
class Peptide:
    name: str
    tokens: tuple[str, ...]
    motif: str | None = None


@dataclass
class Polyprotein:
    peptides: list[Peptide]
    strategy: str = "bisect"
    window: int = 20
    least: int = 2

    def __post_init__(self):
        if self.strategy not in ("boundary", "bisect", "motif"):
            raise ValueError(f"unknown strategy {self.strategy!r}")


def token_span(hits: list[dict] | None, token: str, tolerance: int = TOLERANCE) -> tuple[int, int, float] | None:
    """(from, to, worst E-value) of what a token covers: its best hit, or all its domains in order."""
    names = parse_token(token)
    able = [h for h in hits or [] if h.get("passing")]
    if len(names) == 1:
        mine = [h for h in able if h["target"] == names[0]]
        best = min(mine, key=lambda h: h["dom_evalue"], default=None)
        return best and (best["ali_from"], best["ali_to"], best["dom_evalue"])
    chain: list[dict] = []
    for name in names:
        at = chain[-1] if chain else None
        fits = [h for h in able if h["target"] == name and (at is None or h["ali_from"] > at["ali_from"] and h["ali_to"] > at["ali_to"] and h["ali_from"] > at["ali_to"] - tolerance)]
        if not fits:
            return None
        chain.append(min(fits, key=lambda h: h["ali_to"]))
    return chain[0]["ali_from"], chain[-1]["ali_to"], max(h["dom_evalue"] for h in chain)


def best_span(hits: list[dict] | None, peptide: Peptide, tolerance: int = TOLERANCE) -> tuple[int, int] | None:
    """Of a peptide's alternatives the one with the least E-value."""
    spans = [s for t in peptide.tokens if (s := token_span(hits, t, tolerance))]
    return min(spans, key=lambda s: s[2])[:2] if spans else None


def parent(proteins: list[dict], spec: Polyprotein, tolerance: int = TOLERANCE) -> dict | None:
    """The protein with most peptides in declared order, the longest of equals."""
    best, key = None, (spec.least - 1, -1)
    for p in proteins or []:
        spans = [s for q in spec.peptides if (s := best_span(p.get("hmm_hits"), q, tolerance))]
        if any(a[0] >= b[0] for a, b in zip(spans, spans[1:], strict=False)):
            continue
        k = (len(spans), int(p.get("length") or len(p.get("sequence") or "")))
        if k[0] >= spec.least and k > key:
            best, key = p, k
    return best


def snap(body: str, point: int, motif: str | None, window: int) -> int | None:
    """The place after the last occurrence of ``motif`` that starts within ``window`` of ``point`` (from 1)."""
    if not motif or not body:
        return None
    lo, hi = max(1, point - window), min(len(body), point + window)
    at = body.rfind(motif, lo - 1, hi - 1 + len(motif))
    return at + len(motif) + 1 if at >= 0 else None


def cuts(body: str, spec: Polyprotein, spans: list[tuple[int, int] | None]) -> list[tuple[int, int, str] | None]:
    """(from, to, method) of each declared peptide, or None. A peptide reaches into its immediate neighbours only: next to a
    missing one its edge stays that of its hit; the first and last declared reach the ends."""
    n, m = len(body), len(spans)
    have = [i for i in range(m) if spans[i]]
    if not n or not have or any(spans[a][0] >= spans[b][0] for a, b in zip(have, have[1:], strict=False)):
        return [None] * m
    inside = lambda x: max(1, min(n, x))
    if spec.strategy == "boundary":
        got = [(inside(s[0]), inside(s[1]), "boundary") if s else None for s in spans]
        return [g if g and g[1] >= g[0] else None for g in got]
    border: dict[int, tuple[int, str]] = {}
    for i in have:
        if i + 1 < m and spans[i + 1]:
            (a0, a1), (b0, b1) = spans[i], spans[i + 1]
            # half-even rounding of the middle; of overlapping spans the middle of their centres
            at = max(2, min(n, round((a1 + b0) / 2 if b0 > a1 else ((a0 + a1) / 2 + (b0 + b1) / 2) / 2)))
            motif = spec.peptides[i + 1].motif if spec.strategy == "motif" else None
            to = snap(body, at, motif, spec.window)
            border[i] = (to, f"motif:{motif}") if to is not None else (at, "bisect")
    out: list[tuple[int, int, str] | None] = [None] * m
    for i in have:
        start, how = (1, "n-term") if i == 0 else border.get(i - 1, (spans[i][0], "hit-boundary"))
        stop = n if i == m - 1 else border[i][0] - 1 if i in border else spans[i][1]
        start, stop = inside(start), inside(stop)
        if stop >= start:
            out[i] = (start, stop, how)
    return out


def slicer(spec: Polyprotein, tolerance: int = TOLERANCE):
    """A table function over (id, proteins): a row for each declared peptide, with an empty body where it wasn't found."""

    @udtf(returnType="id string, peptide string, start int, stop int, method string, sequence string")
    class Slice:
        def eval(self, id: str, proteins: list):
            rows = [p if isinstance(p, dict) else p.asDict(True) for p in proteins or []]
            p = parent(rows, spec, tolerance)
            if p is None:
                for q in spec.peptides:
                    yield id, q.name, None, None, "no_parent", None
                return
            got = cuts(p["sequence"] or "", spec, [best_span(p.get("hmm_hits"), q, tolerance) for q in spec.peptides])
            for q, g in zip(spec.peptides, got, strict=True):
                yield (id, q.name, *g, p["sequence"][g[0] - 1 : g[1]]) if g else (id, q.name, None, None, "missing", None)

    return Slice
