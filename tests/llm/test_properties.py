"""Properties of the cores, on generated cases."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from seqpick.llm import chat, common, ctw, decontam, pii, quality, sharding, simhash, suffix

WORDS = st.lists(st.sampled_from([b"a", b"b", b"c", b"dd", b"e" * 40]), max_size=60)


@given(st.integers(1, 10**24), st.integers(0), st.binary(max_size=4))
def test_feistel_round_trip(size, x, tweak):
    f, x = pii.Feistel(b"key"), x % size
    y = f.move(x, size, tweak)
    assert 0 <= y < size and f.move(y, size, tweak, True) == x


@given(st.text(alphabet="ab@.+-0123456789 ()/:=\nAKIAtoken", max_size=200))
@settings(max_examples=300)
def test_pseudonyms_change_only_digits_letters_and_can_go_back(text):
    t = text.encode()
    out, kinds = pii.pseudonyms(t, pii.Feistel(b"k"))
    assert bool(kinds) or out == t
    if not any(k in ("ip", "date") for k in kinds):  # these have no fixed width or order
        assert len(out) == len(t)


@given(st.lists(st.lists(st.integers(0, 2**64 - 1), max_size=700), max_size=5))
@settings(max_examples=60, deadline=None)
def test_majority(runs):
    sizes = np.array([len(r) for r in runs], np.int64)
    got = simhash.majority(np.array([h for r in runs for h in r], np.uint64), sizes)
    for r, g in zip(runs, got.tolist(), strict=True):
        assert g == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in r) > len(r))


@given(WORDS, st.lists(WORDS, max_size=4))
@settings(max_examples=300, deadline=None)
def test_machines_find_every_window(words, items):
    texts = [(i, b" ".join(w)) for i, w in enumerate(items)]
    docs = [words, [], words[::-1], words[:2]]
    spans = set()
    all_words, bounds = decontam.Words([b"-".join(d) for d in docs]), np.cumsum([0, *map(len, docs)])
    assert (all_words.bounds == bounds).all()
    for m in decontam.machines(texts, 3):
        end, pattern = m.search(all_words)
        spans |= {(e - m.length, e, i) for e, p in zip(end.tolist(), pattern.tolist(), strict=True) for i in m.items[m.cuts[p] : m.cuts[p + 1]].tolist()}
    want = set()
    for d, at in zip(docs, bounds.tolist(), strict=False):
        want |= {(at + i, at + i + len(g), k) for k, w in enumerate(items) for g in decontam.windows(w, 3) for i in range(len(d) - len(g) + 1) if tuple(d[i : i + len(g)]) == g}
    assert spans == want


@given(st.lists(st.integers(0, 5), min_size=30, max_size=30), st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=40))
@settings(max_examples=200)
def test_equal_passages_retain_equal_places(shared, a, b, c):
    """A passage of at least a window and a gram has, inside it, the same retained places whatever stands around."""
    k, window = 4, 9

    def places(before, after):
        words = [b"%d" % x for x in (*before, *shared, *after)]
        at = suffix.minimisers(suffix._rolling(suffix._word_hashes(words, {}), k), window)
        lo, hi = len(before), len(before) + len(shared) - k
        # a place is retained by a window; count those whose window lies inside
        h = suffix._rolling(suffix._word_hashes([b"%d" % x for x in shared], {}), k)
        inner = {p for s in range(len(h) - window + 1) for p in range(s, s + window) if h[p] == h[s : s + window].min()}
        assert {p + lo for p in inner} <= set(at.tolist())
        return {p - lo for p in at.tolist() if lo <= p <= hi} & inner

    assert places(a, b) == places(c, a)


@given(st.lists(st.integers(0, 3), max_size=40))
@settings(max_examples=300)
def test_repaired_roles_are_legal(roles):
    way, last = chat.repair(roles)
    state = 0
    for s, action, before in way:
        assert before == state and (action == "merge") == (s == before and action == "merge")
        for g in chat.GAPS[before, s] if action == "turn" else ():
            assert g in chat.LEGAL[state]
            state = g
        assert action == "merge" or s in chat.LEGAL[state]
        state = s
    for g in chat.CLOSING[last]:
        assert g in chat.LEGAL[state]
        state = g
    assert state in (0, 3)


@given(st.lists(st.integers(0, 3), max_size=20), st.lists(st.integers(0, 3), max_size=20))
def test_stretches_combine(a, b):
    assert (chat.product(chat.total(a), chat.total(b)) == chat.total(a + b)).all()


@given(st.integers(0, 10**6), st.integers(0, 10**6))
def test_log_kt(a, b):
    want = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    assert math.isclose(float(ctw.log_kt(np.array([a]), np.array([b]))[0]), want, rel_tol=1e-10, abs_tol=1e-7)  # logs of the size of 10^7 cancel


@given(st.lists(st.integers(0, 500), min_size=1, max_size=12), st.integers(1, 9), st.integers(0, 5))
@settings(max_examples=100, deadline=None)
def test_matrix_keeps_both_sums(blocks, shards, seed):
    m = sharding.matrix(np.array(blocks), shards, seed)
    assert (m >= 0).all() and m.sum(1).tolist() == blocks and m.sum(0).max() - m.sum(0).min() <= 1


@given(st.lists(st.text(alphabet="ab \n#é", max_size=80), max_size=6))
@settings(max_examples=200)
def test_statistics_do_not_depend_on_neighbours(texts):
    together = quality.statistics([t.encode() for t in texts])
    alone = [quality.statistics([t.encode()])[0].tolist() for t in texts]
    assert together.tolist() == alone


def test_written_tables_can_be_dropped(spark):
    df = common.stage_table(spark.range(3), "x")
    assert df.count() == 3
    common.drop_stage_tables(spark)
    again = common.stage_table(spark.range(2), "x")
    assert again.count() == 2
