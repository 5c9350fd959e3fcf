"""Extension beyond the batch operators: the same keys over streams.

``dedup_stream`` drops events seen before within the watermark; ``window_counts`` counts time windows.
Both are plain DataFrame code and give the same rows on a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_stream(df: DataFrame, keys: list[str], ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    if df.isStreaming:
        return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
    return df.dropDuplicates(keys)


def window_counts(df: DataFrame, keys: list[str], value: str, ts: str = "ts", size: str = "1 day", delay: str | None = None) -> DataFrame:
    """``delay``: the watermark, for a stream that has none yet."""
    rows = df.withWatermark(ts, delay) if df.isStreaming and delay else df
    return rows.groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")
