import pytest

from seqpick.plans import pipeline as P

BODIES = ["MKLEVNACDEFGH", "MKLEVNACDEFGA", "MKLEVNACDEFG", "WYWYTTSSPPQQ", "WYWYTTSSPPQA", "GGGGHHHHIIII"]


@pytest.fixture
def pool(records):
    tax = lambda g, f: {"genus": g, "family": f, "lineage": {"subgenus": g.lower()}}
    rows = [{"sequence": s, "host": h, "country": c, "collection_date": d, "taxonomy": tax(g, "F")} for s, h, c, d, g in zip(BODIES, "aaabbb", ["X: y", "X", "Z", "Z", None, ""], ["1997", "1998-01", "2004", "2004", None, "x"], "GGGHHH", strict=True)]
    return records(*rows, {"sequence": BODIES[0], "host": "a"}, {"sequence": "MK", "host": "c", "description": "partial"})


@pytest.mark.parametrize("cfg", [
    {"mode": "host", "n": 1}, {"mode": "geographic", "n": 1}, {"mode": "time", "n": 1, "window": "decade"}, {"mode": "taxonomic1", "n": 1, "rank": "genus"},
    {"mode": "taxonomic1", "n": 1, "rank": "subgenus"}, {"mode": "taxonomic2", "ranks": {"family": 3, "genus": 1}}, {"mode": "global", "n": 2}, {"mode": "global", "threshold": 0.5},
    {"mode": "hybrid", "n": 1, "fields": ["host", "genus"]}, {"mode": "custom", "n": 1, "fields": ["host"], "backend": "greedy", "overflow": "keep"}])
def test_modes_account_for_every_record(pool, cfg):
    r = P.run(pool, P.Config.from_dict(cfg))
    members = [x.member_id for x in r.clusters.collect()]
    assert sorted(members) == [f"r{i}" for i in range(6)]
    assert {(x.id, x.stage) for x in r.removed.collect()} == {("r6", "duplicates"), ("r7", "annotation")}
    reps = {x.id for x in r.representatives.collect()}
    assert reps == {x.rep_id for x in r.clusters.collect()} and len(reps) <= 6


def test_lists_table_and_pins(spark, pool):
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "id string")
    table = spark.createDataFrame([("r1", "k", 0), ("r3", "m", 1)], "accession string, clade string, row_id bigint")
    r = P.run(pool, P.Config(mode="custom", fields=["clade"], n=1, annotate=["clade"]), table, exclude=one("r5"), protect=one("r6"), pins=one("r6", "nope"))
    assert {x.id: x.group_labels["clade"] for x in r.pool.collect()} == {"r0": "Unknown", "r1": "k", "r2": "Unknown", "r3": "m", "r4": "Unknown", "r6": "Unknown"}
    assert "r6" in {x.id for x in r.representatives.collect()} and {(x.id, x.action) for x in r.audit.collect()} >= {("nope", "unavailable")}
    assert [x.id for x in r.protected.collect()] == ["r6"]


def test_segmented_run(records):
    row = lambda i, iso, seg, s: {"id": i, "header": f"{i} ({iso})", "segment": seg, "sequence": s}
    df = records(row("a", "x", "1", "MKKK"), row("b", "x", "2", "MLLL"), row("c", "y", "1", "MKKK"), row("d", "y", "2", "MLLL"), row("e", "z", "1", "MKKK"))
    r = P.run(df, P.Config(mode="global", n=5, virus={"segments": ["PB2", "HA"], "isolate_regex": r"\(([^)]+)\)"}))
    assert [x.id for x in r.representatives.collect()] == ["CONCAT|x"]
    assert {(x.id, x.stage) for x in r.removed.collect()} == {("e", "completeness"), ("CONCAT|y", "duplicates")}


@pytest.mark.parametrize(("bad", "message"), [({"mode": "x"}, "mode"), ({"moed": "host"}, "did you mean 'mode'"), ({"n": 0}, "at least"), ({"mode": "custom"}, "fields"), ({"mode": "taxonomic2"}, "ranks"), ({"threshold": 2.0}, "threshold"), ({"backend": "y"}, "backend")])
def test_config_is_checked(bad, message):
    with pytest.raises(ValueError, match=message):
        P.Config.from_dict(bad)


def test_doctor(spark):
    assert set(P.doctor(spark).values()) >= {"ok"}
