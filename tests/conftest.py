import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def records(spark):
    """Makes records from dicts: defaults as for a plain protein record."""
    from seqpick.schema import RECORD, as_records

    def make(*rows):
        full = []
        for i, r in enumerate(rows):
            r = {"id": f"r{i}", "seq_type": "protein", "source": "ncbi", "is_refseq": False, "is_reviewed": False, "input_ord": i} | r
            full.append({"accession": r["id"], "header": r["id"]} | r)
        cols = [c for c in RECORD if any(c in r for r in full)]
        schema = ", ".join(f"`{c}` {RECORD[c]}" for c in cols)
        return as_records(spark.createDataFrame([tuple(r.get(c) for c in cols) for r in full], schema))

    return make
