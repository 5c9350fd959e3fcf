import pytest
from pyspark.sql import functions as F

from seqpick.sources import fasta, stores, tables
from seqpick.sources.fasta import header_fields


@pytest.fixture(scope="module")
def parse(spark):
    def run(header):
        return spark.createDataFrame([(header,)], "h string").select(header_fields(F.col("h")).alias("f")).first().f

    return run


def test_uniprot_header(parse):
    f = parse("sp|P12345|NAME_HUMAN Some protein, chain A OS=Homo sapiens OX=9606 GN=abc PE=1 SV=2")
    assert (f.source, f.accession, f.description, f.organism, f.taxid, f.is_reviewed) == ("uniprot", "P12345", "Some protein, chain A", "Homo sapiens", 9606, True)
    assert parse("tr|Q1|X Y").is_reviewed is False


def test_virus_header(parse):
    f = parse("MW626064.1 Influenza A virus (A/duck/Philippines/1/2014(H5N1)) segment 6 [Anas] [2014-05] [Philippines: Luzon] [Influenza A virus]")
    assert (f.source, f.organism, f.strain, f.segment, f.collection_date, f.country, f.host) == ("ncbi_virus", "Influenza A virus", "A/duck/Philippines/1/2014", "6", "2014-05", "Anas", "2014-05")
    assert parse("NC_045512.2 thing").is_refseq is True


def test_ncbi_and_plain_headers(parse):
    f = parse("AB123456.1 some gene, complete cds [Foo bar]")
    assert (f.source, f.accession, f.description, f.organism, f.is_refseq) == ("ncbi", "AB123456.1", "some gene, complete cds", "Foo bar", False)
    f = parse("weird header here")
    assert (f.source, f.accession, f.description) == ("unknown", "weird", "weird header here")


def test_fasta_round_trip(spark, tmp_path):
    src = tmp_path / "in.fasta"
    src.write_text(">AB123456.1 one [Foo bar]\nacgt-ac.\r\nGT*\n>x two\nMKLE\n\n>y empty\n")
    fasta.preflight(spark, [str(src)])
    rows = fasta.read_fasta(spark, [str(src)]).orderBy("input_ord").collect()
    assert [(r.id, r.sequence, r.seq_type) for r in rows] == [("AB123456.1", "ACGTACGT", "nucleotide"), ("x", "MKLE", "protein"), ("y", "", "unknown")]
    out = tmp_path / "out"
    fasta.write_fasta(fasta.read_fasta(spark, [str(src)]).where("sequence <> ''").coalesce(1), str(out), width=4)
    text = "".join(p.read_text() for p in sorted(out.glob("part*")))
    assert text == ">AB123456.1 one [Foo bar]\nACGT\nACGT\n>x two\nMKLE\n"
    with pytest.raises(Exception, match="exists"):
        fasta.write_fasta(fasta.read_fasta(spark, [str(src)]), str(out))


def test_preflight_errors(spark, tmp_path):
    (tmp_path / "empty").write_text("\n")
    (tmp_path / "other").write_text("hello\n")
    with pytest.raises(ValueError, match="empty"):
        fasta.preflight(spark, [str(tmp_path / "empty")])
    with pytest.raises(ValueError, match="not FASTA"):
        fasta.preflight(spark, [str(tmp_path / "other")])
    with pytest.raises(FileNotFoundError):
        fasta.preflight(spark, [str(tmp_path / "none")])


def test_several_files_keep_order(spark, tmp_path):
    for n in "ab":
        (tmp_path / n).write_text("".join(f">{n}{i} d\nACGT\n" for i in range(3)))
    rows = fasta.read_fasta(spark, [str(tmp_path / "b"), str(tmp_path / "a")]).orderBy("input_ord").collect()
    assert [r.id for r in rows] == ["b0", "b1", "b2", "a0", "a1", "a2"]


def test_metadata_table(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_bytes("﻿Accession;clade\n AB1.2 ; x \nCD2;\n".encode())
    t = tables.read_metadata(spark, str(p))
    assert t.columns[:2] == ["Accession", "clade"]
    assert [(r.Accession, r.clade) for r in t.collect()] == [("AB1.2", "x"), ("CD2", None)]
    assert {r.key for r in tables.table_keys(t).collect()} == {"ab1", "cd2"}
    (tmp_path / "bad.tsv").write_text("foo\tbar\n1\t2\n")
    with pytest.raises(ValueError, match="key column"):
        tables.read_metadata(spark, str(tmp_path / "bad.tsv"))
    (tmp_path / "none.tsv").write_text("id\tbar\n")
    with pytest.raises(ValueError, match="no rows"):
        tables.read_metadata(spark, str(tmp_path / "none.tsv"))


def test_seqname_keys(spark):
    t = spark.createDataFrame([("PQ1.1|A/duck more words", 0)], "seqName string, row_id bigint")
    assert {r.key for r in tables.table_keys(t).collect()} == {"pq1", "pq1.1_a/duck"}


def test_ids(spark, tmp_path):
    (tmp_path / "ids").write_text("a\n\n# no\n b \n")
    assert [r.id for r in tables.read_ids(spark, str(tmp_path / "ids")).collect()] == ["a", "b"]


def test_id_unions(spark, tmp_path):
    (tmp_path / "ids").write_text("a\nb\n")
    assert sorted(r.id for r in tables.union_ids(spark, ["b ", "c", " "], [str(tmp_path / "ids")]).collect()) == ["a", "b", "c"]
    assert tables.union_ids(spark).count() == 0


def test_clstr(spark):
    lines = [">Cluster 0", "0\t100aa, >x... *", "1\t90aa, >y... at 95.00%", ">Cluster 1", "0\t80aa, >z... *"]
    got = tables.parse_clstr(spark.createDataFrame([(v, i) for i, v in enumerate(lines)], "value string, ord bigint"))
    assert [tuple(r) for r in got.orderBy("cluster", "member").collect()] == [(0, "x", True), (0, "y", False), (1, "z", True)]


def test_domtblout_and_cutoffs(spark):
    row = "PF1 PF1.1 100 q1 - 300 1e-10 50.0 0.1 1 1 1e-9 2e-9 45.0 0.1 5 95 10 110 8 115 0.9 desc of it"
    hits = tables.parse_domtblout(spark.createDataFrame([("# head",), (row,), ("short line",)], "value string")).collect()
    assert [(h.target, h.query, h.hmm_len, h.dom_evalue, h.hmm_from, h.ali_to, h.ali_span) for h in hits] == [("PF1", "q1", 100, 2e-9, 5, 110, 101)]
    lines = ["HMMER3", "NAME  A", "GA    25.0 22.5;", "//", "NAME  B", "//"]
    got = tables.parse_ga_cutoffs(spark.createDataFrame([(v, i) for i, v in enumerate(lines)], "value string, ord bigint"))
    assert {r.name: r.cutoff for r in got.collect()} == {"A": 22.5, "B": None}


def test_cache(spark, tmp_path):
    at = [1000.0]
    c = stores.Cache(spark, str(tmp_path / "cache"), ttl_days=1, now=lambda: at[0])
    assert c.get("ncbi", "1") is None
    c.set("ncbi", "1", {"rank": "species"})
    at[0] += 1
    c.set("ncbi", "1", {"rank": "genus"})
    c.set("uniprot", "P1", None)
    assert c.get("ncbi", "1") == {"rank": "genus"}
    assert {r.source: r.n for r in c.stats().collect()} == {"ncbi": 1, "uniprot": 1}
    at[0] += 90000
    assert c.get("ncbi", "1") is None
    assert c.purge_expired() == 2
    at[0] += 1
    c.set("a", "k", 1)
    at[0] += 1
    assert c.clear("a") == 1 and c.stats().count() == 0


def test_lockfile_and_replay(spark, records, tmp_path):
    rows = records({"id": "a", "sequence": "MK"}, {"id": "b", "sequence": "ML"})
    stores.write_lockfile(spark, str(tmp_path / "lock"), {"seed": 42, "api_key": "secret"}, [], rows)
    head, locked = stores.read_lockfile(spark, str(tmp_path / "lock"))
    assert head["config"] == {"seed": 42}
    found, missing = stores.replay(locked, rows.where("id = 'a'"))
    assert [r.id for r in found.collect()] == ["a"] and [r.id for r in missing.collect()] == ["b"]
