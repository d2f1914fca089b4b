"""Places and running sums in an order that a DataFrame doesn't have of its own, without all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows are numbered by ranges of so many values of their order, and of one key's ranges there are so many at most.
WIDTH, MOST_RANGES = 1 << 16, 1 << 16

_BEFORE = (Window.unboundedPreceding, -1)


def range_width(rows: DataFrame, order: str, width: int = WIDTH) -> int:
    """The width at which order's values, however far apart, fall into MOST_RANGES ranges at most."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    return width if low is None else max(width, -(-(high - low + 1) // (MOST_RANGES - 1)))


def running(rows: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int | None = None) -> DataFrame:
    """rows with name: the sum of value over the rows of the same keys up to this one, by ascending order, a whole number.

    Ranges of width values are summed by themselves and moved by what lies before them.  Rows that tie in order share their sum.
    """
    width = width or (WIDTH if keys else range_width(rows, order))
    cut = rows.withColumn("_v", value).withColumn("_b", F.floor(F.col(order) / width))
    before = F.sum("_s").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(*_BEFORE))
    bases = cut.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s")).select(*keys, "_b", F.coalesce(before, F.lit(0)).alias("_base"))
    within = F.sum("_v").over(Window.partitionBy(*keys, "_b").orderBy(order))
    return cut.withColumn("_w", within).join(bases, [*keys, "_b"]).select(*rows.columns, (F.col("_w") + F.col("_base")).alias(name))


def ordinals(keys: DataFrame, key: str) -> DataFrame:
    """(key, ordinal from 0) of the distinct values of key, a whole number, in its order."""
    distinct = keys.select(key).distinct()
    return running(distinct, [], key, F.lit(1), "ordinal", range_width(keys, key)).select(key, (F.col("ordinal") - 1).alias("ordinal"))


def row_ordinals(rows: DataFrame, group: str, order: str, name: str = "ordinal") -> DataFrame:
    """rows with their place from 0, by group, a whole number, and by order within it; a group is held by one task."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    ends = running(sizes, [], group, F.col("_n"), "_upto", range_width(rows, group)).select(group, (F.col("_upto") - F.col("_n")).alias("_from"))
    at = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return rows.withColumn("_at", at).join(ends, group).select(*rows.columns, (F.col("_from") + F.col("_at")).alias(name))
