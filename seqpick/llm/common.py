"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, all other bytes unchanged.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: White space of the word rule `[^\x20\x09-\x0D]+`; ``bytes.split()`` splits at the same six bytes.
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset in a local session (tests) a temporary folder is made and set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="seqpick-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def _run_dir(spark: SparkSession) -> str:
    """The folder of this application's written tables."""
    return f"{shared_dir(spark).rstrip('/')}/seqpick/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: cuts the lineage, survives executors."""
    path = f"{_run_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete the table that ``stage_table`` returned as ``df``, once nothing unwritten is derived from it."""
    _delete(df.sparkSession, df._written)


def drop_stage_tables(spark: SparkSession) -> None:
    """Delete all written tables of this application, once no DataFrame over them is needed."""
    _delete(spark, _run_dir(spark))


def free_name(taken: Iterable[str], base: str) -> str:
    """``base``, or with underscores before it, so that no column in ``taken`` has the name (in any case)."""
    low = {x.lower() for x in taken}
    while base.lower() in low:
        base = "_" + base
    return base


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` less its columns that an operator's result columns ``names`` would clash with."""
    low = {x.lower() for x in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches with about ``most`` bytes of text at most (a longer text alone), and their texts as bytes."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).to_pylist()
        at = size = 0
        for i, t in enumerate(texts):
            n = len(t or b"") + 64
            if size + n > most and i > at:
                yield batch.slice(at, i - at), texts[at:i]
                at, size = i, 0
            size += n
        if at < len(texts):
            yield batch.slice(at), texts[at:]


def total_text_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a column, one aggregate over the table."""
    return df.agg(F.sum(F.octet_length(F.col(column).cast("string")))).first()[0] or 0
