"""Marker proteins and domain tokens: which protein stands for a record, and why none does."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "--"
#: The similarity gate without a curated cutoff, the model's covered share, the overlap of domains.
EVALUE, COVERAGE, TOLERANCE = 1e-5, 0.5, 30


@dataclass
class Spec:
    """A wanted protein: domain tokens first where the record has been scanned, else product names; bounds on its length."""

    name: str = ""
    hmms: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()
    bounds: tuple[int | None, int | None] | None = None

    def __post_init__(self):
        for t in self.hmms:
            parse_token(t)
        lo, hi = self.bounds or (None, None)
        if lo is not None and hi is not None and lo > hi:
            raise ValueError(f"bounds {self.bounds} are empty")
        if self.bounds == (None, None):
            self.bounds = None

    @property
    def title(self) -> str:
        return self.name or ",".join(self.hmms or self.aliases)


class Pick(NamedTuple):
    protein: dict | None
    reason: str | None = None
    marker: str | None = None
    length: int | None = None


def parse_token(token: str) -> list[str]:
    """`A--B` as its domains in order along the protein."""
    parts = [p.strip() for p in token.split(SEPARATOR)]
    if not all(parts):
        raise ValueError(f"token {token!r} has an empty domain")
    return parts


def passing(hits: Column, cutoffs: dict[str, float] | None = None, evalue: float = EVALUE, coverage: float = COVERAGE) -> Column:
    """Hits with `passing` set: score at the curated cutoff or E-value, and enough of the model covered."""
    ga = F.create_map(*(F.lit(x) for pair in (cutoffs or {}).items() for x in pair)) if cutoffs else F.create_map().cast("map<string,double>")
    span = lambda h: F.least(F.lit(1.0), F.greatest(F.lit(0), h["hmm_to"] - h["hmm_from"] + 1) / F.greatest(F.lit(1), h["hmm_len"]))
    cut = lambda h: F.try_element_at(ga, h["target"])
    similar = lambda h: F.when(cut(h).isNotNull(), h["dom_score"] >= cut(h)).otherwise(h["dom_evalue"] <= evalue)
    return F.transform(hits, lambda h: h.withField("passing", similar(h) & (span(h) >= coverage)))


def token_evalue(hits: list[dict] | None, token: str, tolerance: int = TOLERANCE) -> float | None:
    """The worst E-value of the hits that satisfy a token, or None.

    Domains follow each other with both ends moving on, overlapping by ``tolerance`` at most; at each step the
    hit that ends first leaves the most room for the next.
    """
    names = parse_token(token)
    able = [h for h in hits or [] if h.get("passing")]
    if len(names) == 1:
        mine = [h["dom_evalue"] for h in able if h["target"] == names[0]]
        return min(mine) if mine else None
    at, worst = None, 0.0
    for name in names:
        fits = [h for h in able if h["target"] == name and h["ali_to"] >= h["ali_from"] and (at is None or (h["ali_from"] > at["ali_from"] and h["ali_to"] > at["ali_to"] and h["ali_from"] > at["ali_to"] - tolerance))]
        if not fits:
            return None
        at = min(fits, key=lambda h: h["ali_to"])
        worst = max(worst, at["dom_evalue"])
    return worst


def satisfies(protein: dict, tokens: tuple[str, ...], tolerance: int = TOLERANCE) -> bool:
    return any(token_evalue(protein.get("hmm_hits"), t, tolerance) is not None for t in tokens)


def _size(p: dict) -> int:
    return len(p.get("sequence") or "")


def in_bounds(p: dict, bounds) -> bool:
    lo, hi = bounds or (None, None)
    return (lo is None or _size(p) >= lo) and (hi is None or _size(p) <= hi)


def met_start(p: dict) -> bool:
    return not p.get("sequence") or p["sequence"][:1].upper() == "M"


def pick(proteins: list[dict] | None, specs: list[Spec], scanned: bool = True, need_met: bool = False, tolerance: int = TOLERANCE) -> Pick:
    """The longest protein of the first spec that has one. Without: the worst kind of miss, domains before length before start before name.

    A spec with domains is judged by them alone; a bounded one never falls back. Only where every spec is by unbounded
    names, or there is none, the longest protein stands in.
    """
    able = [p for p in proteins or [] if p.get("sequence")]
    if not able:
        return Pick(None, "no_proteins")
    longest = lambda ps: max(ps, key=_size)
    start_ok = lambda p: not need_met or met_start(p)
    misses: dict[str, Pick] = {}
    loose: Spec | None = None

    def choose(found: list[dict], spec: Spec) -> Pick | None:
        fit = [p for p in found if in_bounds(p, spec.bounds)]
        ready = [p for p in fit if start_ok(p)]
        if ready:
            return Pick(longest(ready))
        if fit:
            misses.setdefault("no_met_start", Pick(None, "no_met_start", spec.title, _size(longest(fit))))
        elif found:
            misses.setdefault("length_out_of_bounds", Pick(None, "length_out_of_bounds", spec.title, _size(longest(found))))
        return None

    for spec in specs:
        if spec.hmms and scanned:
            found = [p for p in able if satisfies(p, spec.hmms, tolerance)]
            if got := choose(found, spec):
                return got
            if not found:
                misses.setdefault("hmm_failed", Pick(None, "hmm_failed", spec.title))
            continue
        if not spec.aliases:
            if spec.bounds and loose is None:
                loose = spec
            continue
        seen: list[dict] = []
        for alias in (a.lower().strip() for a in spec.aliases):
            found = [p for p in able if alias and alias in (p.get("product") or "").lower()]
            ready = [p for p in found if in_bounds(p, spec.bounds) and start_ok(p)]
            if ready:
                return Pick(longest(ready))
            seen += found
        fit = [p for p in seen if in_bounds(p, spec.bounds)]
        if need_met and fit:
            misses.setdefault("no_met_start", Pick(None, "no_met_start", spec.title, _size(longest(fit))))
        elif spec.bounds and seen:
            misses.setdefault("length_out_of_bounds", Pick(None, "length_out_of_bounds", spec.title, _size(longest(seen))))
        elif spec.bounds:
            misses.setdefault("no_alias_match", Pick(None, "no_alias_match", spec.title))
    for kind in ("hmm_failed", "length_out_of_bounds", "no_met_start", "no_alias_match"):
        if kind in misses:
            return misses[kind]
    if loose:
        return choose(able, loose) or next(iter(misses.values()))
    ready = [p for p in able if start_ok(p)]
    return Pick(longest(ready)) if ready else Pick(None, "no_met_start", None, _size(longest(able)))


PICKED = "protein_id string, sequence string, reason string, marker string, length int"


def _plain(x):
    """Arrow rows as plain lists and dicts."""
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return [_plain(v) for v in x] if isinstance(x, list) or hasattr(x, "tolist") and not isinstance(x, str) and getattr(x, "ndim", 0) else x


def with_marker(df: DataFrame, specs: list[Spec], scanned: bool = True, need_met: bool = False, tolerance: int = TOLERANCE, joined: bool = False) -> DataFrame:
    """``df`` with a struct `marker` (protein_id, sequence, reason, marker, length): the pick, or why there is none.

    ``joined``: one pick for each spec, bodies joined in order; the first miss fails the record.
    """

    @F.pandas_udf(PICKED)
    def run(proteins: pd.Series) -> pd.DataFrame:
        out = []
        for ps in proteins:
            ps = _plain(ps) if ps is not None else None
            got = [pick(ps, [s], scanned, need_met, tolerance) for s in specs] if joined else [pick(ps, specs, scanned, need_met, tolerance)]
            bad = next((g for g in got if g.protein is None), None)
            out.append((None, None, bad.reason, bad.marker, bad.length) if bad else (",".join(str(g.protein.get("protein_id")) for g in got), "".join(g.protein["sequence"] for g in got), None, None, None))
        return pd.DataFrame(out, columns=["protein_id", "sequence", "reason", "marker", "length"])

    return df.withColumn("marker", run("proteins"))


def domain_gate(df: DataFrame, specs: dict[str, tuple[str, ...]], tolerance: int = TOLERANCE) -> DataFrame:
    """``df`` with `failed_spec`: the first spec (any token of it will do) that no protein satisfies; all specs must hold."""

    @F.pandas_udf("string")
    def run(proteins: pd.Series) -> pd.Series:
        def first(ps):
            ps = _plain(ps) if ps is not None else []
            return next((name for name, tokens in specs.items() if not any(satisfies(p, tokens, tolerance) for p in ps)), None)

        return proteins.map(first)

    return df.withColumn("failed_spec", run("proteins"))


def claim(proteins: list[dict], specs: list[Spec], tolerance: int = TOLERANCE) -> tuple[dict[str, dict | None], list[str]]:
    """A protein for each spec; one that a domain spec takes is withheld from specs by name, which are told."""
    out: dict[str, dict | None] = {}
    taken: set[int] = set()
    for s in (x for x in specs if x.hmms):
        able = [p for p in proteins if p.get("sequence") and satisfies(p, s.hmms, tolerance) and in_bounds(p, s.bounds)]
        out[s.title] = max(able, key=_size) if able else None
        if able:
            taken.add(id(out[s.title]))
    withheld = []
    for s in (x for x in specs if not x.hmms):
        named = [p for p in proteins if p.get("sequence") and any(a.lower() in (p.get("product") or "").lower() for a in s.aliases) and in_bounds(p, s.bounds)]
        free = [p for p in named if id(p) not in taken]
        out[s.title] = max(free, key=_size) if free else None
        if named and not free:
            withheld.append(s.title)
    return out, withheld


def scan_unique(df: DataFrame, scan) -> DataFrame:
    """Hits of every protein, each distinct body scanned once. ``scan`` maps (aa) to (aa, hits)."""
    long = df.select("id", F.posexplode("proteins").alias("nth", "p")).withColumn("aa", F.col("p.sequence"))
    return long.join(scan(long.select("aa").where("aa is not null").distinct()), "aa", "left")


def isolate_gate(df: DataFrame, specs: dict[str, tuple[str, ...]], prefix: str = "hmm_failed", tolerance: int = TOLERANCE) -> DataFrame:
    """``df`` with `_reason` for records in parts: a part (its record that assembly keeps) without any of its tokens fails its isolate.

    ``specs``: tokens of each part. The failing record says which part and token; all others of the isolate say so as its siblings, by the
    first failure in input order. Records without an isolate pass. ``df`` has isolate_key and segment.
    """

    @F.pandas_udf("string")
    def failed(segment: pd.Series, proteins: pd.Series) -> pd.Series:
        def one(seg, ps):
            tokens = specs.get(seg)
            ps = _plain(ps) if ps is not None else []
            return None if not tokens or any(satisfies(p, tokens, tolerance) for p in ps) else tokens[0]

        return pd.Series([one(s, p) for s, p in zip(segment, proteins, strict=True)])

    # records without an isolate pass, and spread by their own ids
    key = F.coalesce(F.col("isolate_key").cast("string"), F.concat(F.lit("\0"), F.col("id").cast("string")))
    part = Window.partitionBy(key, "segment").orderBy(F.length("sequence").desc(), "input_ord")
    rows = df.withColumn("_judged", (F.row_number().over(part) == 1) & F.col("isolate_key").isNotNull())
    rows = rows.withColumn("_token", F.when(F.col("_judged"), failed("segment", "proteins")))
    own = F.concat_ws(":", F.lit(prefix), "segment", "_token")
    first = F.min(F.when(F.col("_token").isNotNull(), F.struct("input_ord", F.concat_ws(":", "segment", "_token").alias("what")))).over(Window.partitionBy(key))["what"]
    reason = F.when(F.col("isolate_key").isNull(), None).when(F.col("_token").isNotNull(), own).when(first.isNotNull(), F.concat(F.lit(f"{prefix}_sibling:"), first))
    return rows.withColumn("_reason", reason).drop("_judged", "_token")
