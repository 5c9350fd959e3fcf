"""Mixing, sharding, scoring and quality against brute force, and on awkward rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqpick.llm import ctw, mixing, quality, sharding

DOCS = "doc_id bigint, text string, source string, Size string, _text int, Shard int"


@pytest.fixture(scope="module")
def awkward(spark):
    """Null in any column, empty and long texts, repeated rows, columns with the names of results."""
    rows = [(i, " ".join(f"w{(i * 7 + k) % 23}" for k in range(5 + i % 40)), f"s{i % 3}", "x", i, i) for i in range(60)]
    rows += [(100, None, "s0", None, None, None), (101, "", None, "", 0, 0), (None, "a b c", None, None, 1, 1), (102, "long " * 30000, "s1", "x", 1, 1)]
    rows += [(7, rows[7][1], "s1", "x", 7, 7)] * 3
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def targets(sizes, weights=(5.0, 2.0, 1.0), cap=3):
    """Resharing the excess again and again."""
    w = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    free, left, out = set(sizes), float(sum(sizes.values())), {}
    while True:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > cap * sizes[s] + 1e-12}
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        free -= over


def check_mix(rows, slack):
    sizes, taken, want = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        want[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    for r in rows:
        assert r.source_size == sizes[r.source]
    for s, t in targets(sizes).items():
        assert want[s] == pytest.approx(t) and abs(taken[s] - t) <= slack, (s, t, taken[s])


def test_mix_meets_targets(awkward):
    got = mixing.mix(awkward).collect()
    assert len(got) == awkward.count()
    check_mix(got, 3 * mixing.BLOCK)
    again = mixing.mix(awkward.repartition(3)).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))


def test_mix_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 20)
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 90 + 1).cast("int")).alias("text"))
    check_mix(mixing.mix(df).collect(), 20 * mixing.BLOCK)


def test_mix_small_source_is_capped(spark):
    df = spark.createDataFrame([(1, "a", "w " * 10), (2, "b", "w " * 4000), (3, "c", "w " * 400)], "doc_id int, source string, text string")
    got = {r.source: r for r in mixing.mix(df).collect()}
    assert got["a"].target == 30 and got["a"].taken == 30
    check_mix(list(got.values()), 3 * mixing.BLOCK)


def test_mix_of_nothing(empty, spark):
    assert mixing.mix(empty).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, ""), (2, "a", None)], "doc_id int, source string, text string")).collect()
    assert [(r.size, r.taken) for r in got] == [(0, 0), (0, 0)]


def test_apportion_is_highest_quotients(spark):
    rng = np.random.default_rng(3)
    for n in (1, 7, 40, 200):
        share = rng.integers(1, 500, 12).astype(float)
        cap = rng.integers(1, 60, 12)
        n = min(n, int(cap.sum()))
        df = spark.createDataFrame([(1, i, float(s), int(c), int(n)) for i, (s, c) in enumerate(zip(share, cap, strict=True))], "g int, place int, share double, cap bigint, seats bigint")
        got = {r.place: r.q for r in mixing.apportion(df, ["g"], ["place"], "share", "seats", "cap", "q").collect()}
        k = [0] * 12
        for _ in range(n):
            best = max((i for i in range(12) if k[i] < cap[i]), key=lambda i: (share[i] / (2 * k[i] + 1), -i))
            k[best] += 1
        assert sum(got.values()) == n and [got[i] for i in range(12)] == k


def test_repeat_takes_whole_copies(awkward):
    out = mixing.repeat(awkward)
    assert out.columns == awkward.columns and dict(out.dtypes) == dict(awkward.dtypes)
    assert 0 < out.count() <= 3 * 3 * awkward.count()


def test_repeat_keeps_targets_whatever_the_ids(spark):
    for ids in ([None, None], [5, 5]):
        df = spark.createDataFrame([(ids[0], "w " * 40, "a"), (ids[1], "v " * 4000, "b")], "doc_id int, text string, source string")
        got = Counter(r.source for r in mixing.repeat(df).collect())
        assert got["a"] == 3 and got["b"] in (0, 1)


def test_chosen_blocks_against_brute_force(spark, monkeypatch):
    """One-block documents: which are taken tells which blocks are chosen."""
    monkeypatch.setattr(mixing, "SHARDS", 1)
    df = spark.range(301).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.repeat(F.lit("w "), F.lit(mixing.BLOCK)).alias("text"))
    more = df.unionByName(spark.createDataFrame([(1000, "t", "w " * mixing.BLOCK * 180)], "doc_id long, source string, text string"))
    rows = [r for r in mixing.mix(more).collect() if r.source == "s"]
    base, rest = divmod(sum(r.taken for r in rows), 301 * mixing.BLOCK)
    up = [r.taken // mixing.BLOCK - base for r in rows]
    assert set(up) <= {0, 1} and sum(up) == rest // mixing.BLOCK and abs(sum(r.taken for r in rows) - rows[0].target) <= mixing.BLOCK
    # the line in order, and the choice told again: of each stretch its share, those with the least hash
    line = spark.createDataFrame([(r.doc_id,) for r in rows], "id long").join(more.select(F.col("doc_id").alias("id"), "text"), "id")
    order = [r.id for r in line.orderBy(F.xxhash64(F.xxhash64("id", "text"), F.lit(mixing.SEED + 1)), "id").collect()]
    hashed = [r.h for r in spark.range(301).select(F.xxhash64(F.lit("s"), F.lit(0), "id", F.lit(mixing.SEED + 4)).alias("h")).orderBy("id").collect()]
    turn = spark.range(1).select(F.pmod(F.xxhash64(F.lit("s"), F.lit(0), F.lit(mixing.SEED + 2)), F.lit(1 << 20)) / (1 << 20)).first()[0]
    want, k = set(), sum(up)
    for a in range(0, 301, mixing.STRETCH):
        b = min(a + mixing.STRETCH, 301)
        q = math.floor(b * k / 301 + turn) - math.floor(a * k / 301 + turn)
        want |= {order[i] for i in sorted(range(a, b), key=lambda i: hashed[i])[:q]}
    assert want == {r.doc_id for r, u in zip(rows, up, strict=True) if u}


def test_shards_are_exact(awkward, empty):
    for shards in (1, 7, 40):
        got = sharding.deal(awkward, shards).collect()
        sizes = Counter(r.shard for r in got)
        assert len(got) == awkward.count() and max(sizes.values()) - min(sizes.values()) <= 1
        slots = defaultdict(set)
        for r in got:
            slots[r.shard].add(r.slot)
        assert all(slots[s] == set(range(n)) for s, n in sizes.items())
        assert Counter(map(str, got)) == Counter(map(str, sharding.deal(awkward.repartition(5), shards).collect()))
    for r in got:
        t = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 16, zlib.crc32(t), "rows", None)
    assert sharding.deal(empty).count() == 0 and sharding.deal(awkward, 200).count() == awkward.count()


def test_shards_over_many_blocks_and_cells(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 50)
    monkeypatch.setattr(sharding, "CELL", 16)
    df = spark.range(3001).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.deal(df, 7).collect()
    sizes = Counter(r.shard for r in got)
    assert sorted(sizes.values()) == [428, 428, 429, 429, 429, 429, 429]
    assert {(r.shard, r.slot) for r in got} == {(s, k) for s, n in sizes.items() for k in range(n)}
    # neighbours in the input are no neighbours in the shards
    place = {r.doc_id: (r.shard, r.slot) for r in got}
    near = sum(place[i][0] == place[i + 1][0] and abs(place[i][1] - place[i + 1][1]) == 1 for i in range(3000))
    assert near < 15


def test_matrix_sums():
    m = sharding.matrix(np.array([100, 0, 57, 1000]), 7)
    assert m.sum(1).tolist() == [100, 0, 57, 1000] and m.sum(0).max() - m.sum(0).min() <= 1
    rng = np.random.default_rng(0)
    draw = [sharding._draw(rng, 2 * 10**9, 10**9, 3000) for _ in range(200)]
    assert abs(np.mean(draw) - 2000) < 10


def test_large_draws_have_the_law():
    rng = np.random.default_rng(0)
    got = np.bincount([sharding._draw_large(rng, 30, 70, 20) for _ in range(6000)], minlength=21)
    want = np.array([math.comb(30, k) * math.comb(70, 20 - k) / math.comb(100, 20) for k in range(21)]) * 6000
    full = want > 5
    assert ((got - want)[full] ** 2 / want[full]).sum() < 40
    assert sharding._draw_large(rng, 5, 3, 8) == 5 and sharding._draw_large(rng, 0, 3, 2) == 0


def test_matrix_has_the_law():
    """Two blocks into two shards: the first cell against the hypergeometric weights, over seeds."""
    got = Counter(int(sharding.matrix(np.array([6, 4]), 2, seed)[0, 0]) for seed in range(4000))
    for k in range(1, 6):
        want = math.comb(5, k) * math.comb(5, 6 - k) / math.comb(10, 6) * 4000
        assert abs(got[k] - want) < 5 * want**0.5 + 5


def test_every_row_may_come_anywhere(spark):
    """Over seeds, each of eight rows falls into each of four shards about as often."""
    df = spark.range(8).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    seen = Counter()
    for seed in range(12):
        for r in sharding.deal(df, 4, seed=seed * 17).collect():
            seen[r.doc_id] += 1 << (8 * r.shard)
    assert all(sum(v >> (8 * s) & 255 for s in range(4)) == 12 and sum((v >> (8 * s) & 255) > 0 for s in range(4)) >= 2 for v in seen.values())


def test_shards_by_wide_numbers_and_of_one_id(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") * 0).alias("doc_id"), F.col("id").cast("string").alias("text"))
    for stride in (sharding.STRIDE, 2):
        monkeypatch.setattr(sharding, "STRIDE", stride)
        got = sharding.deal(df, 7).collect()
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
        assert sorted(map(len, by.values())) == [428] * 3 + [429] * 4 and all(sorted(v) == list(range(len(v))) for v in by.values())
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 100)
    blocks = df.groupBy(F.pmod(F.xxhash64(F.xxhash64("doc_id", "text"), F.lit(sharding.SEED)), F.lit(30))).count()
    assert blocks.count() == 30  # one id, but many blocks


def brute_base(rows):
    """The contract's unigram figures."""
    toks = {i: [*(t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split(), b"\n"] for i, (_, t) in enumerate(rows)}
    held = {i: d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for i, (d, _) in enumerate(rows)}
    c = Counter(w for i, ws in toks.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return [(held[i], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in toks.items()]


def brute_ctw(rows, depth):
    """The same tree, one bit at a time, without logs of sums."""
    docs = [b" ".join((t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()) + b"\n" for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    n = defaultdict(lambda: [0, 0])
    kids = defaultdict(set)

    def walk(d):
        line = b"\n" * depth + d
        for i in range(depth, len(line)):
            for t in range(8):
                pre, bit = (1 << t) | (line[i] >> (8 - t)), (line[i] >> (7 - t)) & 1
                yield [(line[i - k : i], pre) for k in range(depth + 1)], bit

    for d, h in zip(docs, held, strict=True):
        for path, bit in walk(d):
            for k, node in enumerate(path):
                if not h:
                    n[node][bit] += 1
                    if k:
                        kids[path[k - 1]].add(node)
    memo = {}

    def pw(node, k):
        if node not in memo:
            a, b = n[node]
            kt = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            if k == depth:
                memo[node] = (kt, kt)
            else:
                s = sum(pw(c, k + 1)[0] for c in kids[node])
                m = max(kt, s)
                memo[node] = (m + math.log((math.exp(kt - m) + math.exp(s - m)) / 2), kt)
        return memo[node]

    out = []
    for d in docs:
        total = 0.0
        for path, bit in walk(d):
            p = None
            for k in range(depth, -1, -1):
                a = n[path[k]] if path[k] in n else [0, 0]
                if k and a[0] + a[1] == 0:
                    continue
                own = (a[bit] + 0.5) / (sum(a) + 1)
                if p is None or k == depth:
                    p = own
                else:
                    w, kt = pw(path[k], k)
                    stay = 0.5 * math.exp(kt - w)
                    p = stay * own + (1 - stay) * p
            total += math.log10(p)
        out.append(total)
    return out


def test_ctw_against_plain_tree(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["the", "Of", "tion", "ab", "é", "x"], int(rng.integers(1, 30))))) for i in range(40)] + [(40, None), (41, ""), (None, "the of"), (3, "the of zz"), (3, "the of zz")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id bigint, text string, score string")
    got = {}
    for r in ctw.score(df).collect():
        got.setdefault((r.doc_id, r.n_tokens, round(r.base_score, 6)), []).append(r)
    base, own = brute_base(rows), brute_ctw(rows, ctw.DEPTH)
    for (d, _), (held, n, known, train, b), s in zip(rows, base, own, strict=True):
        r = got[d, n, round(b, 6)][0]
        assert (r.held_out, r.n_known, r.train_tokens) == (held, known, train)
        assert r.base_score == pytest.approx(b) and r.score == pytest.approx(s, rel=1e-9)
    assert sum(map(len, got.values())) == len(rows)


def test_ctw_without_training_or_rows(spark, empty):
    assert ctw.score(empty).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = ctw.score(spark.createDataFrame([(held, "ab")], "doc_id int, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 2, 0, 0, 0.0) and r.score == pytest.approx(24 * math.log10(0.5))


def test_lookup_walks_the_tree():
    docs = [b"the cat\n", b"a\n", b"\n", "é x\n".encode()]
    k = np.unique(ctw.grams(docs, 3))
    look = ctw.Lookup(k, np.arange(len(k)), 3)
    assert (k[look.of(docs)] == ctw.grams(docs, 3)).all()


def brute_stats(text):
    t = text or ""
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in t).split(" ") if w]
    lines = [x for x in t.split("\n") if x.strip(" \t\v\f\r")]
    win = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {k for i in range(len(words) - 4) if win[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    return [len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)]


def test_statistics_against_plain_counts(awkward):
    texts = [r.text for r in awkward.collect()] + ["a b c d e a b c d e", "x\nx\n \n \nx #|", "ünï cödé\u2003w", "a a a a a a", "\n\n", "<b>\t&amp;\v\f\r"]
    got = quality.statistics([t.encode() if t is not None else None for t in texts])
    assert got.tolist() == [brute_stats(t) for t in texts]


def test_quality_rejects_junk_and_keeps_clean(spark):
    rng = np.random.default_rng(1)
    vocab = [f"word{i}" for i in range(3000)]
    rows, labels = [], []
    for i in range(400):
        w = list(rng.choice(vocab, int(rng.integers(20, 400))))
        junk = i % 10 == 0
        rows.append((i, " ".join(x + "###" if junk else x for x in w), "own"))
        labels.append((i, 0 if junk else 1))
    rows += [(1000, None, "own"), (1001, "", "own"), (1002, "too short", "own"), (1003, "a b c d e f " * 30, "own"), (None, rows[1][1], "own")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kept string")
    lab = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality.judge(df, quality.fit(df, lab)).collect()}
    assert not any(got[i].kept for i in (1000, 1001, 1002, 1003)) and all(got[i].base_failed for i in (1000, 1001, 1002, 1003))
    assert sum(got[i].kept for i in range(0, 400, 10)) == 0 and sum(not got[i].kept for i in range(400) if i % 10) <= 4
    assert got[None].kept == got[1].kept


def test_forest_against_plain_recursion(spark):
    """Path lengths told node by node, the threshold from the scores of good rows, and the verdicts that follow."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(("x#" if i % 9 == 0 else "word") + "y" * int(rng.integers(1, 5)) for _ in range(int(rng.integers(10, 60))))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    forest = quality.fit(df, spark.createDataFrame([(i, int(i % 9 > 0)) for i in range(200)], "doc_id bigint, quality int"))

    def path(node, x):
        while forest["feature"][node] >= 0:
            node = forest["left"][node] + int(x[forest["feature"][node]] >= forest["cut"][node])
        return forest["depth"][node]

    def mean_depth(n):  # of an unsuccessful search in a tree of n points
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    scores, good = {}, []
    for i, t in rows:
        counts = brute_stats(t)
        n = counts[0]
        rate = [counts[1] / n, -counts[1] / n, *(c / n for c in counts[2:])]
        x = [math.sqrt(max(r - v, 0)) for r, v in zip(rate, forest["levels"], strict=True)]
        scores[i] = 2 ** -(sum(path(r, x) for r in forest["roots"]) / len(forest["roots"]) / mean_depth(quality.SUBSAMPLE))
        if i % 9 and n >= 10 and 100 * counts[4] <= 20 * n:
            good.append(scores[i])
    top = sorted(good)[math.ceil((1 - quality.SPARE) * (len(good) - 1))]
    assert forest["threshold"] == pytest.approx(max(top, float(np.median(list(scores.values())))), abs=1e-8)
    for r in quality.judge(df, forest).collect():
        assert r.anomaly == pytest.approx(scores[r.doc_id]) and r.kept == (not r.base_failed and r.anomaly <= forest["threshold"])


def test_quality_is_fitted_to_every_labelled_row(spark):
    """More labelled rows than 4,096: levels and threshold are those of all of them."""
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"{j}" + "w" * int(k) for j, k in enumerate(rng.integers(1, 9, 10)))) for i in range(6500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    forest = quality.fit(df, df.select("doc_id", F.lit(1).alias("quality")))
    counts = quality.statistics([t.encode() for _, t in rows])
    assert not quality.base_failed(counts).any()
    assert np.allclose(forest["levels"], np.quantile(quality.rates(counts), 1 - quality.TAIL, axis=0))
    scores = np.sort(quality.anomaly(forest, quality.features(counts, forest["levels"])))
    want = max(scores[math.ceil((1 - quality.SPARE) * (len(rows) - 1))], np.median(scores))
    assert forest["threshold"] == pytest.approx(want, abs=1e-8) and len(forest["roots"]) == quality.TREES


def test_quality_without_labels_or_rows(spark, empty, awkward):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    for lab in (none, None):
        assert quality.judge(empty, quality.fit(empty, lab)).count() == 0
        assert quality.judge(awkward, quality.fit(awkward, lab)).count() == awkward.count()


def test_parts_of_long_texts_join_to_the_coded_text():
    rng = np.random.default_rng(2)
    for text in (None, b"", b"  ", b"A b\tC", b"x" * 90, b" ".join(rng.choice([b"aB", b"\xc3\xa9t", b"q" * 30, b""], 200)) + b" \n "):
        words, line = ctw.coded(text)
        got = list(ctw.parts(text, 3, 40))
        assert [w for ws, _ in got for w in ws] == words and b"".join(x[3:] for _, x in got) == line
        assert np.array_equal(np.concatenate([ctw._keys([x], 3) for _, x in got]), ctw.grams([line], 3))
