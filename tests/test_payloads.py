from pyspark.sql import functions as F

from seqpick.sources import payloads as P

TAXA = "<TaxaSet><Taxon><TaxId>5</TaxId><ScientificName>A b</ScientificName><Rank>Species</Rank><LineageEx>{}</LineageEx></Taxon></TaxaSet>"
NODE = "<Taxon><ScientificName>{}</ScientificName><Rank>{}</Rank></Taxon>"
FLAT = '''LOCUS       MW1  20 bp
ACCESSION   MW1
VERSION     MW1.2
FEATURES             Location/Qualifiers
     source          1..20
                     /organism="x"
                     /strain="A/duck
                     one"
                     /segment=4
     CDS             join(1..9,
                     12..20)
                     /product="hemag ""HA"" glutinin"
                     /protein_id="P1.1"
                     /translation="MKL
                     VV"
     CDS             1..3
                     /product="no body"
ORIGIN
        1 acgt
//
LOCUS       AB2
ACCESSION   AB2
FEATURES             Location/Qualifiers
     source          1..2
                     /isolate="i"
ORIGIN
//
'''


def column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")


def test_taxonomy_xml(spark):
    line = "".join(NODE.format(n, r) for n, r in (("V", "superkingdom"), ("x", "no rank"), ("c", "clade"), ("F", "family"), ("F2", "Family"), ("", "genus")))
    df = column(spark, [TAXA.format(line), TAXA.format(NODE.format("Other", "species")), "<bad", None, "", "<TaxaSet></TaxaSet>"])
    got = [r.t for r in df.orderBy("i").select(P.taxonomy_xml(F.col("v")).alias("t")).collect()]
    assert got[0].taxid == 5 and got[0].species == "A b" and got[0].family == "F" and got[0].genus is None
    assert got[0].lineage == {"superkingdom": "V", "family": "F", "species": "A b"}
    assert got[1].species == "Other" and got[2:] == [None] * 4


def test_taxonomy_json(spark):
    text = '{"scientificName": "S", "lineage": [{"rank": "genus", "scientificName": "G"}, {"rank": "Genus", "scientificName": "H"}, {"rank": "no rank", "scientificName": "n"}, {"rank": "clade", "scientificName": "c"}]}'
    df = column(spark, [text, "{bad", None, '{"scientificName": "S"}'])
    got = [r.t for r in df.orderBy("i").select(P.taxonomy_json(F.col("v"), F.lit(7)).alias("t")).collect()]
    assert (got[0].taxid, got[0].species, got[0].genus, got[0].lineage) == (7, "S", "H", {"genus": "H", "clade": "c"})
    assert got[1:3] == [None, None] and got[3].species == "S" and got[3].lineage == {}


def test_entry(spark):
    text = '{"entryType": "UniProtKB reviewed (Swiss-Prot)", "organism": {"scientificName": "O", "taxonId": 3, "lineage": ["a", "b"]}, "organismHosts": [{"scientificName": "duck"}, {"scientificName": "cat"}], "proteinDescription": {"recommendedName": {"fullName": {"value": "d"}}}}'
    got = [r.e for r in column(spark, [text, '{"entryType": "other"}', "[", None]).orderBy("i").select(P.entry_json(F.col("v")).alias("e")).collect()]
    assert tuple(got[0]) == (True, "O", 3, ["a", "b"], "duck", "d") and tuple(got[1]) == (False, None, None, None, None, None) and got[2:] == [None, None]


def test_summary(spark):
    body = '{"result": {"uids": ["7", "8"], "7": {"organism": "o", "taxid": 5, "title": "t", "subtype": "host|country|isolate|serotype|host", "subname": "duck|X|i|H5N1|cat"}, "8": {"organism": "p", "taxid": 0, "subtype": "geo_loc_name|country|strain|isolate", "subname": "Y|X||i"}}}'
    df = column(spark, [body, '{"result": {}}', "x", None]).orderBy("i")
    got = [r.e for r in df.select(P.summary_json(F.col("v")).alias("e")).collect()]
    assert tuple(got[0]) == ("o", 5, "t", "cat", "X", None, "i", "H5N1") and got[1:] == [None] * 3
    assert tuple(df.select(P.summary_json(F.col("v"), F.lit("8")).alias("e")).first().e) == ("p", None, None, None, "Y", None, "i", None)


def test_flat_records(spark):
    df = column(spark, [FLAT, FLAT.replace("\n", "\r\n").replace("MW1", "ZZ9"), "", None, "junk"]).select(F.col("v").alias("value"))
    got = {r.accession: r for r in P.flat_records(df).collect()}
    assert set(got) == {"MW1.2", "AB2", "ZZ9.2"} | {"AB2"}
    assert tuple(got["MW1.2"].source) == (None, "A/duck one", "4", None) and tuple(got["AB2"].source) == ("i", None, None, None)
    assert [tuple(p) for p in got["MW1.2"].proteins] == [("P1.1", 'hemag "HA" glutinin', 5, "MKLVV"), (None, "no body", None, None)]
    assert got["AB2"].proteins == [] and got["ZZ9.2"].proteins == got["MW1.2"].proteins


def test_long_translation(spark):
    text = 'VERSION     L1\nFEATURES             x\n     CDS             1..3\n                     /translation="' + "\n                     ".join(["M" * 58] * 20_000) + '"\nORIGIN\n//\n'
    assert P.flat_records(column(spark, [text]).select(F.col("v").alias("value"))).first().proteins[0].length == 58 * 20_000


def test_answers(spark):
    df = column(spark, [">A.1 x\nac-g\nt\n>B.2\nGG\n>C\n>\nAA\n", None, ""]).select(F.col("v").alias("value"))
    parsed = P.bodies(df)
    wanted = spark.createDataFrame([("A",), ("A.1",), ("A.9",), ("B.2",), ("C",), ("Q",), (None,)], "accession string")
    got = {r.accession: r.sequence for r in P.answers(wanted, parsed).collect()}
    assert got == {"A": "ACGT", "A.1": "ACGT", "A.9": "ACGT", "B.2": "GG", "C": None, "Q": None}


def test_models(spark):
    text = "x\nBest-fit model according to BIC: GTR+F+I\n\n  ID  Model           Speed  Parameters\n\n   1  LG+G4   1.0  a\n   2  JTT     0.5  b\n   1  WAG  2 c\n\n   3  late  1 d\n"
    df = spark.createDataFrame([("p", text), ("q", "Best-fit model: HKY chosen according to AIC\n"), ("r", "none"), ("s", None)], "path string, value string")
    assert sorted(map(tuple, P.chosen_models(df).collect())) == [("p", "GENOME", "GTR+F+I"), ("q", "GENOME", "HKY")]
    assert sorted(map(tuple, P.chosen_models(df, ["HA", "NA", "M"]).collect())) == [("p", "HA", "WAG"), ("p", "NA", "JTT")]
    assert P.chosen_models(df, []).count() == 0


def test_alignment_roles(spark):
    want = {
        "run_msa.fasta": ("genome", "", False), "run_msa_untrimmed.fasta": ("genome", "", True), "run_msa_fam.fasta": ("partition_family", "fam", False), "run_other.fasta": ("genome", "other", False),
        "run_per_protein/HA_msa.fasta": ("marker", "HA", False), "run_extra_protein/run_X_msa_untrimmed.fasta": ("extra_protein", "X", True), "a/run_polyprotein/nsp1_msa.fasta": ("peptide", "nsp1", False),
        "run_per_segment/S_msa.fasta": ("segment_nt", "S", False), "run_more/S": ("more", "S", False),
    }
    df = spark.createDataFrame([(p,) for p in want], "path string")
    assert {r.path: tuple(r.m) for r in df.select("path", P.alignment_role(F.col("path"), "run").alias("m")).collect()} == want


def test_a_payload_is_parsed_once(spark):
    """Whatever is taken of a payload's columns, the plan has one call of the parser of each text."""
    df = column(spark, [TAXA.format(""), None])
    lower = lambda got: got._jdf.queryExecution().optimizedPlan().toString().lower()
    tax = lower(df.select(P.taxonomy_xml(F.col("v")).alias("t")).select("t.taxid", "t.genus", "t.species", "t.lineage"))
    assert tax.count("from_xml(") + tax.count("xmltostructs(") == 1
    # the answer, its list of ids and the record are three texts
    got = lower(df.select(P.summary_json(F.col("v")).alias("e")).select("e.organism", "e.host", "e.strain", "e.taxid"))
    assert got.count("from_json(") + got.count("jsontostructs(") == 3
