"""Comparison of two runs: positions, lines and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: The largest difference that an export is accepted with.
TOLERANCE = 1e-3


def differing_lines(a: Column, b: Column) -> Column:
    """How many lines of two texts differ by position, lines that only one has included; null if a
    text is missing, 0 if they are equal. A line end at the end of a text begins no further line."""

    def count(pair: Column) -> Column:
        # the shorter list is filled up with nulls, which equal no line
        same = F.zip_with(pair["left"], pair["right"], lambda x, y: F.coalesce(x == y, F.lit(False)))
        return F.size(F.filter(same, lambda s: ~s))

    # as a variable of a function, the lists of lines are made once and not at each use
    pair = F.array(F.struct(text.lines(a).alias("left"), text.lines(b).alias("right")))
    return F.when(a.isNull() | b.isNull(), None).when(a == b, 0).otherwise(F.transform(pair, count)[0])


def verdict(a: Column, b: Column) -> Column:
    n = differing_lines(a, b)
    return F.struct(F.when(n.isNotNull(), F.when(a == b, "identical").otherwise("differ")).alias("verdict"), n.alias("lines"))


def equal_pairs(a: DataFrame, b: DataFrame, key: str = "position") -> DataFrame:
    """One row: positions that both sides (position, value) have, and those with equal values."""
    pairs = a.select(key, F.col("value").alias("a")).join(b.select(key, F.col("value").alias("b")), key)
    return pairs.agg(F.count("*").alias("compared"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("equal"))


def first_differences(a: DataFrame, b: DataFrame, n: int = 20, width: int = 220, key: str = "position") -> DataFrame:
    """The first n positions whose values differ, both values cut to a width."""
    pairs = a.select(key, F.col("value").alias("a")).join(b.select(key, F.col("value").alias("b")), key)
    return pairs.where(~F.col("a").eqNullSafe(F.col("b"))).orderBy(key).limit(n).select(key, F.left("a", F.lit(width)).alias("a"), F.left("b", F.lit(width)).alias("b"))


def alignment(pairs: DataFrame, a: str = "a", b: str = "b", tolerance: float = TOLERANCE) -> DataFrame:
    """Largest and mean absolute difference of two number columns, and whether it is accepted."""
    gap = F.abs(F.col(a) - F.col(b))
    sums = pairs.agg(F.max(gap).alias("max_gap"), F.avg(gap).alias("mean_gap"))
    return sums.withColumn("accepted", F.coalesce(F.col("max_gap") < tolerance, F.lit(False)))
