"""Exact ranks and most frequent keys without one task that sorts them all."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one window group holds on average; beyond the square of it, as many as there are groups.
GROUP_ROWS = 20_000


def groups_for(rows: int) -> int:
    """Groups for ``rows``: neither a group nor the list of groups, which one task orders, outgrows the root of the rows."""
    return max(1, -(-rows // max(GROUP_ROWS, math.isqrt(rows))))


def with_rank(df: DataFrame, keys: list[str], bucket: str, order: list[Column], name: str, total: str | None = None, weight: str | None = None) -> DataFrame:
    """Adds the 1-based rank of each row among its ``keys``, ordered by bucket, then ``order``.

    With ``weight`` a row stands for so many rows, and its rank is that of the first of them.
    Counts by (keys, bucket) are summed up first; then only rows of one bucket
    are sorted together, so a key with a third of all rows is spread over its
    buckets. Keys and bucket must not be null. ``total`` adds the key's row count."""
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    counts = df.groupBy(*keys, bucket).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(by.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n"))
    if total:
        before = before.withColumn(total, F.sum("_n").over(by))
    joined = df.join(before.drop("_n"), [*keys, bucket])
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    place = F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(weight) + 1 if weight else F.row_number().over(inside)
    return joined.withColumn(name, F.col("_before") + place).drop("_before")


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of ``counts`` (with a column c) down to a count that at most ``most`` rows reach, found from counts of counts."""
    level = F.floor(F.log2("c") * 16)
    left, least = most, None
    for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect():  # under 1,100 levels
        left -= r["n"]
        if left < 0:
            break
        least = r["level"]
    return counts.where(F.lit(False) if least is None else level >= least)
