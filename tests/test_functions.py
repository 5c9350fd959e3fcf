import pytest
from pyspark.sql import functions as F

from seqpick.functions import stats
from seqpick.functions import text as X


def values(spark, column, rows, name="x", kind="string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], f"{name} {kind}").select(column).collect()]


def test_match_key(spark):
    rows = [" NC_045512.2 ", "A/Foo  Bar/1", "AB1.1|", "", None, "__", "x.y"]
    assert values(spark, X.match_key(F.col("x")), rows) == ["nc_045512", "a/foo_bar/1", "ab1", None, None, None, "x.y"]


def test_norm_id_keeps_version(spark):
    assert values(spark, X.norm_id(F.col("x")), ["A b|c.1", " "]) == ["a_b_c.1", None]


def test_label_key(spark):
    assert values(spark, X.label_key(F.col("x")), ["HA clade", "2.3.4 b", "--", None]) == ["ha_clade", "b", "", ""]


@pytest.mark.parametrize(("body", "kind"), [("ACGT", "nucleotide"), ("ACGTNNNN", "nucleotide"), ("NNN", "nucleotide"), ("", "unknown"), ("MKLE", "protein"), ("KRWMHS", "protein"), ("acgtk" * 3, "protein"), ("ACGTACGTAK", "nucleotide"), (None, "unknown")])
def test_seq_type(spark, body, kind):
    assert values(spark, X.seq_type(F.col("x")), [body]) == [kind]


def test_ambiguity_by_alphabet(spark):
    assert values(spark, X.ambiguity(F.col("x"), "protein"), ["AXBZ", "acgn", ""]) == [0.75, 0.0, 0.0]
    assert values(spark, X.ambiguity(F.col("x"), "nucleotide"), ["ACGN", "nnrr"]) == [0.25, 1.0]


def test_keywords_bound_only_word_edges(spark):
    hit = X.keyword_hit(F.col("x"), F.lit("header"))
    assert values(spark, hit, ["MAG: something", "a partial cds", "impartial", "Uncultured virus", "complete"]) == ["MAG:", "partial", None, "Uncultured", None]
    assert values(spark, X.keyword_hit(F.lit(" "), F.col("x")), ["synthetic thing"]) == ["synthetic"]


@pytest.mark.parametrize(("window", "label"), [("year", "1997"), ("decade", "1990s"), (5, "1995-1999")])
def test_windows(spark, window, label):
    y = X.year(F.col("x"), F.lit("A/duck/1/1997"))
    assert values(spark, X.window_label(y, window), ["no date", "18 May 1997"]) == [label, label]
    assert values(spark, X.window_label(X.year(F.col("x")), window), ["2150", None]) == ["Unknown", "Unknown"]


def test_country(spark):
    assert values(spark, X.country(F.col("x")), ["USA: Iowa", " ", None, ":x"]) == ["USA", "Unknown", "Unknown", "Unknown"]


def test_strain_parts(spark):
    got = spark.createDataFrame([("A/human/Hong_Kong/1/1997(H5N1)",), ("B/duck/X/2/2001(mixed, partial)",), ("isolate 2004",)], "x string").select(*(c.alias(k) for k, c in X.strain_parts(F.col("x")).items())).collect()
    assert tuple(got[0]) == ("Homo sapiens", "Hong Kong", "1997", "H5N1")
    assert tuple(got[1]) == ("duck", "X", "2001", None)
    assert tuple(got[2]) == (None, None, "2004", None)


def test_rank_from_name(spark):
    assert values(spark, X.rank_from_name(F.col("x")), ["Coronaviridae", "Nidovirales", "Betacoronavirus", "Human virus", "", "Pisoniviricetes"]) == ["family", "order", "genus", "no rank", "no rank", "class"]


def test_protein_accession(spark):
    assert values(spark, X.looks_like_protein_accession(F.col("x")), ["YP_1.1", "ABC12345", "NC_1", None]) == [True, True, False, False]


def test_natural_key_orders_numbers(spark):
    df = spark.createDataFrame([("v10",), ("v2",), ("v1a",)], "x string")
    assert [r.x for r in df.orderBy(X.natural_key(F.col("x"))).collect()] == ["v1a", "v2", "v10"]


def test_exclusive_quartiles(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4, 10)] + [("b", 7)], "g string, v int")
    got = {r.g: r for r in df.groupBy("g").agg(*stats.quartiles("v")).collect()}
    assert (got["a"].min, got["a"].max, got["a"].median, got["a"].iqr, got["a"].n) == (1, 10, 3, 6, 5)  # 7.0 - 1.5 is 5.5, to even
    assert (got["b"].median, got["b"].iqr) == (7, 0)


def test_distances(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "c"]), ([], []), ([], ["a"])], "a array<string>, b array<string>")
    got = df.select(stats.jaccard_distance(F.col("a"), F.col("b")), stats.containment_distance(F.col("a"), F.col("b"))).collect()
    assert [tuple(round(x, 6) for x in r) for r in got] == [(0.333333, 0.0), (0.0, 0.0), (1.0, 1.0)]


def test_resolve(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("c", None)], "g string, v string")
    assert {r.g: r.v for r in df.groupBy("g").agg(stats.resolve(F.col("v")).alias("v")).collect()} == {"a": "x", "b": "Conflict", "c": None}


def test_colours_are_hex(spark):
    got = values(spark, X.hue_colour(F.col("x")), list(range(5)), kind="int")
    assert len(set(got)) == 5 and all(len(c) == 7 and c[0] == "#" and int(c[1:], 16) >= 0 for c in got)


def test_percent_cell(spark):
    assert spark.range(1).select(X.percent_cell(F.lit(1), F.lit(8)), X.percent_cell(F.lit(0), F.lit(0))).first()[:] == ("1 12%", "0 ---")
