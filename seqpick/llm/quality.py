"""Quality rules: an isolation forest on rule statistics.

One Arrow pass counts a document's rule statistics over its whole text and runs the trees on
them. Everything fitted comes from all labelled rows: the level of each statistic that all but ``TAIL`` of the good rows
stay within, the trees, each grown from its own ``SUBSAMPLE`` rows drawn from all of them, as the method has it, on how far
a row goes beyond these levels (good rows coincide at zero, so few splits
isolate what breaks a rule), and the score above which a document counts as anomalous. On plain rates the
same forest was measured to find half as much junk at the same loss: junk makes clusters, which few splits don't isolate.

Nulls, empty texts: no words; the fixed rules reject them. A null label is no label. Repeated
rows are judged row by row, alike. An empty table gives an empty result; without labelled rows of
good quality the forest is grown from unlabelled rows and only its farthest ``SPARE`` share fails. A very
long text is counted whole, alone in its slice; equal scores have equal verdicts. Input columns named like a
result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_table, free_name, stage_table, text_slices, without

TREES, SUBSAMPLE, SEED = 100, 64, 17
#: The share of good rows beyond the level of a statistic.
TAIL = 0.001
#: The share of good labelled rows that the threshold may cost.
SPARE = 0.002
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RESULT = [*COUNTS, "base_failed", "anomaly", "kept"]
SLICE = 4 << 20
#: White space and the later bytes of a code point: what is left are the code points in words.
NOT_COUNTED = b" \t\n\v\f\r" + bytes(range(0x80, 0xC0))


def _repeats(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words stand in a window of five that its own text has twice or more. Exact: windows become ranks by pairs."""
    n = len(ids)
    hit = np.zeros(n, bool)
    if n < 5:
        return hit
    rank, m = ids.astype(np.int64), int(ids.max()) + 1
    two = np.unique(rank[:-1] * m + rank[1:], return_inverse=True)[1]
    m2 = int(two.max()) + 1
    four = np.unique(two[:-2] * m2 + two[2:], return_inverse=True)[1]
    whole = np.flatnonzero(doc[: n - 4] == doc[4:])
    if not len(whole):
        return hit
    five = np.unique(four[whole] * m + rank[whole + 4], return_inverse=True)[1]
    _, at, size = np.unique(five * (int(doc.max()) + 1) + doc[whole], return_inverse=True, return_counts=True)
    starts = whole[size[at] > 1]
    for k in range(5):
        hit[starts + k] = True
    return hit


def _dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """COUNTS of each text, as an int64 matrix."""
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    words: list[bytes] = []
    for i, t in enumerate(texts):
        if t:
            w = t.split()
            words += w
            out[i, 0] = len(w)
            out[i, 1] = len(t.translate(None, NOT_COUNTED))
            out[i, 2] = len(t) - len(t.translate(None, SYMBOLS))
            out[i, 3] = _dup_lines(t)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    doc = np.repeat(np.arange(len(texts)), out[:, 0])
    out[:, 4] = np.bincount(doc[_repeats(ids, doc)], minlength=len(texts))
    return out


def base_failed(counts: np.ndarray) -> np.ndarray:
    """The fixed rules: under ten words, or over a fifth of them in repeated windows."""
    return (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])


def rates(counts: np.ndarray) -> np.ndarray:
    """The rule statistics by word, so that a text's length plays no part; mean word length counts both ways."""
    n = np.maximum(counts[:, 0], 1).astype(float)
    return np.column_stack([counts[:, 1] / n, -counts[:, 1] / n, counts[:, 2] / n, counts[:, 3] / n, counts[:, 4] / n])


def features(counts: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """How far each rate lies beyond its level, as a root."""
    return np.sqrt(np.maximum(rates(counts) - levels, 0))


def _path(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(x: np.ndarray, seed: int = SEED, trees: int = TREES, subsample: int = SUBSAMPLE) -> dict:
    """An isolation forest as flat arrays: feature (-1: leaf), cut, left child (right: the next), depth."""
    rng = np.random.default_rng(seed)
    apart = rng.permutation(len(x)) if len(x) >= trees * subsample else None  # enough rows: no two trees share one
    feature, cut, left, depth, roots = [], [], [], [], []
    limit = int(np.ceil(np.log2(max(2, min(subsample, len(x))))))

    def node() -> int:
        for a, v in ((feature, -1), (cut, 0.0), (left, 0), (depth, 0.0)):
            a.append(v)
        return len(feature) - 1

    for t in range(trees if len(x) else 0):
        rows = x[rng.choice(len(x), min(subsample, len(x)), replace=False) if apart is None else apart[t * subsample : (t + 1) * subsample]]
        roots.append(node())
        todo = [(roots[-1], rows, 0)]
        while todo:
            k, r, d = todo.pop()
            lo, hi = r.min(0), r.max(0)
            able = np.flatnonzero(hi > lo)
            if d >= limit or len(r) < 2 or not len(able):
                depth[k] = d + _path(len(r))
                continue
            f = int(rng.choice(able))
            c = float(rng.uniform(lo[f], hi[f]))
            feature[k], cut[k] = f, c
            a, b = node(), node()
            left[k] = a
            todo += [(a, r[r[:, f] < c], d + 1), (b, r[r[:, f] >= c], d + 1)]
    return {"feature": np.array(feature, np.int32), "cut": np.array(cut), "left": np.array(left, np.int32), "depth": np.array(depth), "roots": np.array(roots, np.int32), "limit": limit, "scale": _path(min(subsample, len(x))) or 1.0, "threshold": 1.1}


def anomaly(forest: dict, x: np.ndarray) -> np.ndarray:
    """2^(-mean path / scale), in (0, 1]: near 1 for what few splits isolate; 0 without trees."""
    total = np.zeros(len(x))
    if not len(forest["roots"]):
        return total
    row = np.arange(len(x))
    for root in forest["roots"]:
        at = np.full(len(x), root, np.int32)
        for _ in range(forest["limit"]):
            f = forest["feature"][at]
            inner = f >= 0
            at = np.where(inner, forest["left"][at] + (x[row, np.maximum(f, 0)] >= forest["cut"][at]), at)
        total += forest["depth"][at]
    return np.power(2.0, -total / len(forest["roots"]) / forest["scale"])


def _greatest(rows: DataFrame, column: str, n: int) -> np.ndarray:
    """The ``n`` greatest values, descending: a small share of the rows reaches the driver."""
    return np.array([r[0] for r in rows.select(column).orderBy(F.desc(column)).limit(n).collect()], float)


def _level(rows: DataFrame, column: str, n: int, share: float) -> float:
    """The quantile of ``share`` over all ``n`` rows, between two values in proportion, as ``np.quantile`` has it."""
    at = (n - 1) * share
    top = _greatest(rows, column, n - int(at))[::-1]
    return float(top[0] + (at - int(at)) * (top[min(1, len(top) - 1)] - top[0]))


def fit(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", spare: float = SPARE) -> dict:
    """Grow the forest and set its threshold from all labelled rows (all rows, if ``labels`` is None).

    Trees grow from junk and good rows alike. The threshold is the lowest that fails at most
    ``spare`` of the rows with label 1, and never under the median score.
    """
    names = [f"r{i}" for i in range(len(COUNTS))]
    ids = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), F.lit(SEED)).alias("_h"), F.col(text_col).cast("string").alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "_text", SLICE):
            c = statistics(texts)
            yield pa.RecordBatch.from_arrays([*part.columns[:2], *map(pa.array, rates(c).T), pa.array(base_failed(c))], names=["_id", "_h", *names, "_failed"])

    schema = T.StructType([*ids.schema.fields[:2], *(T.StructField(c, T.DoubleType()) for c in names), T.StructField("_failed", T.BooleanType())])
    rows = ids.mapInArrow(count, schema)
    if labels is None:
        rows = rows.withColumn("_good", ~F.col("_failed"))
    else:  # numbers are joined, not texts
        known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).dropna()
        rows = rows.join(known.groupBy("_id").agg(F.max("_label").alias("_label")), "_id").withColumn("_good", (F.col("_label") == 1) & ~F.col("_failed"))
    rows = stage_table(rows.select("_h", "_good", *names), "rates")
    n, some = rows.agg(F.count("*"), F.count(F.when(F.col("_good"), 1))).first()
    good = F.col("_good") if some else F.lit(True)
    some = some or n
    levels = np.array([_level(rows.where(good), c, some, 1 - TAIL) if n else 0.0 for c in names])
    drawn = rows.orderBy("_h", *names).limit(TREES * SUBSAMPLE).select(*names).toPandas().to_numpy(float).reshape(-1, len(names))
    forest = grow(np.sqrt(np.maximum(drawn - levels, 0))) | {"levels": levels}
    if n:
        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.column_stack([b.column(c).to_numpy() for c in names])
                yield pa.RecordBatch.from_arrays([b.column("_good"), pa.array(anomaly(forest, np.sqrt(np.maximum(x - levels, 0))))], names=["_good", "s"])

        scores = stage_table(rows.select("_good", *names).mapInArrow(score, "_good boolean, s double"), "scores")
        # of the good rows' scores in order, the first at or after the place of the share
        least = float(_greatest(scores.where(good), "s", some - int(np.ceil((1 - spare) * (some - 1))))[-1]) + 1e-9
        under = scores.where(F.col("s") <= least).count()
        forest["threshold"] = least if 2 * under > n else max(least, scores.agg(F.percentile("s", F.lit(0.5))).first()[0])
        drop_table(scores)
    drop_table(rows)
    return forest


def judge(docs: DataFrame, forest: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with RESULT: the counts, the fixed rules' verdict, the anomaly score and the verdict of both."""
    docs = without(docs, RESULT)
    whole = free_name(docs.columns, "_text")
    kinds = [T.LongType()] * len(COUNTS) + [T.BooleanType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*docs.schema, *(T.StructField(c, k) for c, k in zip(RESULT, kinds, strict=True))])
    model = docs.sparkSession.sparkContext.broadcast(forest)  # TREES * 2 * SUBSAMPLE nodes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, whole, SLICE):
            c = statistics(texts)
            failed, score = base_failed(c), anomaly(model.value, features(c, model.value["levels"]))
            kept = ~failed & (score <= model.value["threshold"])
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, c.T), pa.array(failed), pa.array(score), pa.array(kept)], names=[*part.schema.names[:-1], *RESULT])

    return docs.withColumn(whole, F.col(text_col).cast("string")).mapInArrow(run, schema)
