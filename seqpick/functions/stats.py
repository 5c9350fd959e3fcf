"""Aggregates over groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exclusive_quantile(values: Column, p: float) -> Column:
    """Quantile of a sorted array by the exclusive method: at p * (n + 1), clipped to the ends."""
    n = F.size(values)
    j = F.greatest(F.lit(1), F.least(n - 1, F.floor(F.lit(p) * (n + 1)).cast("int")))
    part = F.lit(p) * (n + 1) - j
    return F.when(n == 1, values[0]).otherwise(F.element_at(values, j) * (1 - part) + F.element_at(values, j + 1) * part)


def quartiles(value: str) -> list[Column]:
    """min, max, median, iqr and n as aggregates; medians and spreads round half to even."""
    sorted_values = F.array_sort(F.collect_list(F.col(value).cast("double")))
    return [
        F.min(value).cast("bigint").alias("min"), F.max(value).cast("bigint").alias("max"),
        F.bround(F.median(value)).cast("bigint").alias("median"),
        F.when(F.count(value) > 1, F.bround(exclusive_quantile(sorted_values, 0.75) - exclusive_quantile(sorted_values, 0.25))).otherwise(0.0).cast("bigint").alias("iqr"),
        F.count(value).alias("n"),
    ]


def resolve(value: Column) -> Column:
    """One value for many: null of none, the value of one, `Conflict` of several."""
    lo, hi = F.min(value), F.max(value)
    return F.when(lo != hi, "Conflict").otherwise(lo)


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - |A and B| / |A or B|; two empty sets are equal."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 0.0).otherwise(1 - both / (F.size(a) + F.size(b) - both))


def containment_distance(a: Column, b: Column) -> Column:
    """1 - |A and B| / the lesser size; one empty set is far from all but another empty one."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 0.0).when((F.size(a) == 0) | (F.size(b) == 0), 1.0).otherwise(1 - F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))
