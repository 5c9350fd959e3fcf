"""URL filters: gradient-boosted trees on lexical features, with DataFrame and SQL functions only.

A domain rule fits its host and all subdomains where the URL's path starts with the rule's path; the
longest rule that fits decides. URLs that a rule decides are the labelled ones, besides any labelled
table that is given: from at most ``FIT_ROWS`` of them (least seeded hash) the trees are boosted on
the log loss, level by level, by sums of gradients per node, feature and bin. The fitted trees are
one SQL expression over the features, which judges every URL that no rule fits.

Features: lengths of host, path and query, depth of the path, labels of the host, share of digits,
entropy of the characters, number of parameters, hyphens, and the smoothed rates of blocked URLs by
last host label and by first path part in the fitting sample; the trees grow on rates that leave out the
row's own of ``FOLDS`` folds, so that no label tells its own rate.

A null URL, or one without `://`, has an empty host and path; rules with a non-empty host don't fit
it and the trees judge it. Repeated rows are judged alike, URLs of any length whole; between splits of equal
gain the first feature and the least cut win. With no labelled row, or labels of one
kind only, the trees give that kind's verdict, and allow without any. An empty table gives an empty
result. Input columns named like a result column are replaced.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, stage_table, without

#: The labelled rows that the trees are grown from, at most.
FIT_ROWS = 8192
TREES, DEPTH, BINS, RATE, LAMBDA, LEAST = 8, 3, 16, 0.4, 1.0, 5.0
SEED, FOLDS = 613, 5
RESULT = ["host", "path", "rule", "score", "verdict"]
#: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
FEATURES = ["host_len", "path_len", "query_len", "depth", "labels", "digits", "entropy", "params", "hyphens", "suffix_rate", "part_rate"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def lexical(df: DataFrame, url: str, host: str, path: str, names: dict[str, str]) -> DataFrame:
    """The features that need no statistics, and the keys of the two that do."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    n = F.length(text).cast("double")
    chars = F.array_sort(F.split(text, ""))
    # of sorted characters the entropy is a fold over runs: n log n less the sum of c log c
    zero = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("n"), F.lit(0.0).alias("s"))
    end = lambda a: a["s"] + F.when(a["n"] > 0, a["n"] * F.log2(a["n"])).otherwise(0.0)
    fold = F.aggregate(chars, zero, lambda a, c: F.when(a["c"] == c, F.struct(a["c"].alias("c"), (a["n"] + 1).alias("n"), a["s"].alias("s"))).otherwise(F.struct(c.alias("c"), F.lit(1.0).alias("n"), end(a).alias("s"))), end)
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    made = {
        "host_len": F.length(host), "path_len": F.length(path), "query_len": F.length(query),
        "depth": F.regexp_count(F.col(path), F.lit("/")), "labels": F.regexp_count(F.col(host), F.lit(r"[^.]+")),
        "digits": F.regexp_count(text, F.lit("[0-9]")) / F.greatest(n, F.lit(1.0)),
        "entropy": F.when(n > 0, F.log2(n) - fold / n).otherwise(0.0),
        "params": F.when(F.length(query) > 0, F.regexp_count(query, F.lit("&")) + 1).otherwise(0),
        "hyphens": F.regexp_count(F.col(host), F.lit("-")),
    }
    keys = {"suffix_key": F.regexp_extract(host, r"([^.]*)$", 1), "part_key": F.regexp_extract(path, r"^/([^/]*)/", 1)}
    return df.withColumns({names[k]: v.cast("double") for k, v in made.items()} | {names[k]: v for k, v in keys.items()})


def _rates(fit: DataFrame, key: str, prior: float) -> DataFrame:
    """The smoothed rate of label 1 by key; at most FIT_ROWS keys."""
    return fit.groupBy(key).agg(((F.sum("label") + 4 * prior) / (F.count("*") + 4)).alias("rate"))


def _other_rates(fit: DataFrame, key: str, prior: float) -> DataFrame:
    """The same by key and fold, of the rows in other folds."""
    each = Window.partitionBy(key)
    per = fit.groupBy(key, "fold").agg(F.sum("label").alias("s"), F.count("*").alias("n"))
    left = lambda c: F.sum(c).over(each) - F.col(c)
    return per.select(key, "fold", ((left("s") + 4 * prior) / (left("n") + 4)).alias("rate"))


def _bins(fit: DataFrame) -> dict[str, list[float]]:
    """Cut points of each feature, between its distinct values."""
    q = [i / BINS for i in range(1, BINS)]
    got = fit.agg(*(F.percentile_approx(f, q, 10000).alias(f) for f in FEATURES)).first()
    return {f: sorted(set(got[f] or [])) for f in FEATURES}


def boost(fit: DataFrame, trees: int = TREES, depth: int = DEPTH) -> tuple[float, list[list[tuple]]]:
    """Trees as lists of (node, feature, cut) and (node, None, value). ``fit``: FEATURES, label; in one small partition."""
    n, ones = fit.agg(F.count("*"), F.sum("label")).first()
    if not n or not ones or ones == n:
        return (0.0 if not n else 6.0 if ones else -6.0) if n else -6.0, []
    base = math.log(ones / (n - ones))
    cuts = _bins(fit)
    binned = fit.select("label", *(sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0)).cast("int").alias(f) for f in FEATURES))
    # a written table of at most FIT_ROWS rows: one small job a level reads it
    rows = stage_table(binned.groupBy("label", *FEATURES).agg(F.count("*").cast("double").alias("w")), "boost").coalesce(1)
    forest: list[list[tuple]] = []
    for _ in range(trees):
        raw = sum((_tree(t, {f: F.col(f) for f in FEATURES}, cuts) for t in forest), F.lit(base))
        p = 1 / (1 + F.exp(-raw))
        state = rows.withColumn("p", p).withColumns({"g": F.col("w") * (F.col("p") - F.col("label")), "h": F.col("w") * F.col("p") * (1 - F.col("p"))})
        tree: list[tuple] = []
        alive: dict[int, tuple[float, float] | None] = {1: None}  # open nodes and their sums, as their parents' splits tell them
        place = F.lit(1)
        for level in range(depth + 1):
            best = {r.node: r.b for r in _splits(state.withColumn("node", place)).collect()} if level < depth else {}  # 2^depth rows
            after, next_place = {}, place
            for node, sums in sorted(alive.items()):
                b = best.get(node)
                if b is None or b.gain is None:
                    g, h = sums or (b.gt, b.ht)
                    tree.append((node, None, -RATE * g / (h + LAMBDA)))
                    continue
                f, k = -b.f, -b.bin
                tree.append((node, FEATURES[f], cuts[FEATURES[f]][k]))
                after |= {2 * node: (b.gl, b.hl), 2 * node + 1: (b.gt - b.gl, b.ht - b.hl)}
                next_place = F.when(place == node, F.when(F.col(FEATURES[f]) > k, 2 * node + 1).otherwise(2 * node)).otherwise(next_place)
            alive, place = after, next_place
            if not alive:
                break
        forest.append(tree)
    return base, forest


def _splits(state: DataFrame) -> DataFrame:
    """(node, b): the best split of each node with its sums; gain null where none is good enough."""
    long = state.select("node", "g", "h", F.posexplode(F.array(*FEATURES)).alias("f", "bin")).groupBy("node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    run = Window.partitionBy("node", "f").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("node", "f")
    side = long.withColumns({"gl": F.sum("g").over(run), "hl": F.sum("h").over(run), "gt": F.sum("g").over(whole), "ht": F.sum("h").over(whole)})
    gr, hr = F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")
    gain = F.round(F.col("gl") ** 2 / (F.col("hl") + LAMBDA) + gr**2 / (hr + LAMBDA) - F.col("gt") ** 2 / (F.col("ht") + LAMBDA), 9)
    good = (F.col("hl") > LEAST / 10) & (hr > LEAST / 10) & (gain > 1e-6)
    side = side.withColumn("gain", F.when(good, gain))
    # nulls sort first, so a split that is good enough wins
    return side.groupBy("node").agg(F.max(F.struct("gain", (-F.col("f")).alias("f"), (-F.col("bin")).alias("bin"), "gl", "hl", "gt", "ht")).alias("b"))


def _tree(tree: list[tuple], col: dict[str, Column], cuts: dict[str, list[float]] | None = None) -> Column:
    """A tree as nested CASE WHEN. ``cuts``: the columns hold bins, not values."""
    by = {node: (f, v) for node, f, v in tree}

    def build(node: int) -> Column:
        f, v = by.get(node, (None, 0.0))
        if f is None:
            return F.lit(float(v))
        return F.when(col[f] > (cuts[f].index(v) if cuts else F.lit(float(v))), build(2 * node + 1)).otherwise(build(2 * node))

    return build(1)


class Model(NamedTuple):
    base: float
    forest: list[list[tuple]]
    prior: float
    #: (suffix_key, rate) and (part_key, rate), at most FIT_ROWS rows each.
    suffix: DataFrame
    part: DataFrame


def fit(labelled: DataFrame) -> Model:
    """The trees and rates of a small table (url, label)."""
    sample = labelled.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    sample = lexical(sample, "url", "host", "path", {k: k for k in [*FEATURES, "suffix_key", "part_key"]})
    rows = sample.withColumn("fold", F.pmod(F.xxhash64("url", F.lit(SEED + 1)), F.lit(FOLDS)).cast("int"))
    n, ones = rows.agg(F.count("*"), F.sum("label")).first()
    prior = ones / n if n else 0.0
    for key, name in (("suffix_key", "suffix_rate"), ("part_key", "part_rate")):
        rows = rows.join(F.broadcast(_other_rates(rows, key, prior).withColumnRenamed("rate", name)), [key, "fold"])
    base, forest = boost(stage_table(rows.select("label", *FEATURES), "urlfit").coalesce(1))
    return Model(base, forest, prior, _rates(sample, "suffix_key", prior), _rates(sample, "part_key", prior))


def score(df: DataFrame, model: Model, url: str, host: str, path: str, names: dict[str, str]) -> tuple[DataFrame, Column]:
    """``df`` with the features in columns ``names``, and the Column of the probability that a URL is to be blocked."""
    df = lexical(df, url, host, path, names)
    for stats, k, f in ((model.suffix, "suffix_key", "suffix_rate"), (model.part, "part_key", "part_rate")):
        df = df.join(F.broadcast(stats.select(F.col(k).alias(names[k]), F.col("rate").alias(names[f]))), names[k], "left").fillna(model.prior, [names[f]])
    raw = sum((_tree(t, {f: F.col(names[f]) for f in FEATURES}) for t in model.forest), F.lit(model.base))
    return df, 1 / (1 + F.exp(-raw))


def known_urls(pages: DataFrame, url_col: str = "url", rules=RULES, labelled: DataFrame | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(url, label; 1: block): at most ``fit_rows`` of the URLs that a rule decides and of ``labelled``, as a written table."""
    url = F.col(url_col).cast("string")
    pick = pages.select(url.alias("url"), _rule(host_of(url), path_of(url), rules).alias("pick"))
    known = pick.where("pick is not null").select("url", (F.col("pick.verdict") == "block").cast("int").alias("label"))
    if labelled is not None:
        known = known.unionByName(labelled.select(F.col("url").cast("string"), F.col("label").cast("int")).dropna())
    return stage_table(known.orderBy(F.xxhash64("url", F.lit(SEED)), "url", "label").limit(fit_rows), "urls").coalesce(1)


def held_out_accuracy(known: DataFrame) -> float:
    """The share of a fifth of the labelled URLs (by host) that trees grown from the others judge as labelled."""
    fold = F.pmod(F.xxhash64(host_of(F.col("url")), F.lit(SEED + 2)), F.lit(FOLDS))
    model = fit(known.where(fold != 0))
    rest = known.where(fold == 0).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rest, p = score(rest, model, "url", "host", "path", {k: k for k in [*FEATURES, "suffix_key", "part_key"]})
    return rest.agg(F.avg(((p > 0.5).cast("int") == F.col("label")).cast("double"))).first()[0]


def judge(pages: DataFrame, url_col: str = "url", rules=RULES, labelled: DataFrame | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``pages`` with RESULT. ``labelled``: url, label (1: block), further labelled URLs."""
    pages = without(pages, RESULT)
    own = list(pages.columns)
    taken = [*own, *RESULT]
    names = {k: free_name(taken, f"_{k}") for k in [*FEATURES, "suffix_key", "part_key", "pick"]}
    url = F.col(url_col).cast("string")
    df = pages.withColumn("host", host_of(url)).withColumn("path", path_of(url)).withColumn(names["pick"], _rule(F.col("host"), F.col("path"), rules))
    df, p = score(df, fit(known_urls(pages, url_col, rules, labelled, fit_rows)), url_col, "host", "path", names)
    df = df.withColumn("score", p).withColumn("rule", F.col(names["pick"])["rule"])
    df = df.withColumn("verdict", F.coalesce(F.col(names["pick"])["verdict"], F.when(F.col("score") > 0.5, "block").otherwise("allow")))
    return df.select(*(F.col(f"`{c}`") for c in own), *RESULT)
