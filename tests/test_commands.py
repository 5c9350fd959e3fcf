import json

import pytest

from seqpick.__main__ import main, parse_ranks


@pytest.fixture
def source(tmp_path):
    bodies = ["MKLEVNACDEFGH", "MKLEVNACDEFGA", "WYWYTTSSPPQQ", "GGGGHHHHIIII", "GGGGHHHHIIII"]
    p = tmp_path / "in.fasta"
    p.write_text("".join(f">sp|P{i}|X_Y Some protein OS=Foo bar OX={i + 1}\n{b}\n" for i, b in enumerate(bodies)))
    return str(p)


def read(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part*")))


def test_select_and_replay(spark, source, tmp_path, capsys):
    out = tmp_path / "out"
    assert main(["global", "-T", "0.5", "-i", source, "-o", str(out)]) == 0
    text = read(out / "representatives.fasta")
    assert text.count(">") == 3 and "exact_duplicate_of:P3" in read(out / "qc_removed")
    assert "representatives 3" in capsys.readouterr().out
    other = tmp_path / "again"
    assert main(["replay", str(out / "lock"), "-i", source, "-o", str(other)]) == 0
    assert read(other / "representatives.fasta").count(">") == 3 and "0 missing" in capsys.readouterr().out


def test_custom_with_table_and_lists(spark, source, tmp_path):
    (tmp_path / "t.tsv").write_text("accession\tclade\nP0\ta\nP1\ta\nP2\tb\n")
    (tmp_path / "pins").write_text("P1\n")
    out = tmp_path / "out"
    args = ["custom", "-f", "clade", "-n", "1", "-i", source, "-o", str(out), "--metadata-table", str(tmp_path / "t.tsv"), "--annotate-field", "clade", "--pin-ids", str(tmp_path / "pins")]
    assert main(args) == 0
    assert {line.split("|")[1] for line in read(out / "representatives.fasta").splitlines() if line[0] == ">"} == {"P1", "P2", "P3"}


def test_stats_doctor_cache_config(spark, source, tmp_path, capsys):
    assert main(["stats", "-i", source]) == 0
    text = capsys.readouterr().out
    assert "5 records" in text and "source uniprot: 5" in text and "organism: 5 of 5" in text and "host: 0 of 5" in text
    assert main(["doctor"]) == 0 and "arrow udf: ok" in capsys.readouterr().out
    assert main(["cache", "stats", str(tmp_path / "none")]) == 0
    assert main(["init-config"]) == 0
    cfg = json.loads(capsys.readouterr().out)
    (tmp_path / "c.json").write_text(json.dumps(cfg))
    assert main(["host", "-n", "2", "-c", str(tmp_path / "c.json"), "-i", source, "-o", "x", "--dry-run"]) == 0


@pytest.mark.parametrize(("args", "message"), [(["global"], "--threshold or -n"), (["host", "-n", "0"], "at least 1"), (["host", "-n", "1", "--annotate-field", "x"], "metadata table")])
def test_errors_are_told(spark, source, tmp_path, capsys, args, message):
    assert main([*args, "-i", source, "-o", str(tmp_path / "o")]) == 2
    assert message in capsys.readouterr().err


def test_missing_input(spark, tmp_path, capsys):
    assert main(["host", "-n", "1", "-i", str(tmp_path / "none"), "-o", str(tmp_path / "o")]) == 2
    assert "not found" in capsys.readouterr().err


def test_unknown_key(tmp_path, capsys):
    (tmp_path / "c.yaml").write_text("overflw: trim\n")
    assert main(["host", "-n", "1", "-c", str(tmp_path / "c.yaml"), "-i", "x", "-o", "y", "--dry-run"]) == 2
    assert "did you mean 'overflow'" in capsys.readouterr().err


def test_rank_levels():
    assert parse_ranks("family:20, genus:5") == {"family": 20, "genus": 5} == parse_ranks('[{"rank":"family","n_per_group":20},{"rank":"genus","n_per_group":5}]')
