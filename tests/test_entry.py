import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_catalogue_against_sql(spark):
    import duckdb

    from seqpick.plans import catalogue

    db = duckdb.connect()
    for p in os.listdir(SMALL):
        db.execute(f"create view {p.removesuffix('.parquet')} as select * from '{SMALL}/{p}'")
    flat = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else tuple(map(flat, v)) if isinstance(v, list | tuple) else v
    bad = []
    for name, run in catalogue.queries().items():
        df = run(spark, SMALL)
        cols = sorted(df.columns)
        rows = sorted((tuple(flat(r[c]) for c in cols) for r in df.collect()), key=repr)
        sql = catalogue.oracle_sql().get(name)
        if sql:
            got = db.execute(sql)
            names = [d[0] for d in got.description]
            if sorted(names) != cols or rows != sorted((tuple(flat(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=repr):
                bad.append(name)
    assert not bad


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
