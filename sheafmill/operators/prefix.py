"""Running sums over a whole table without a task that sees all of it.

Rows are put into buckets of even width between the smallest and the largest key, about SPAN rows
each where keys are dense or spread evenly, such as hashes; a window runs inside each bucket, and another
over one row per bucket. Ten billion keys make some 150,000 bucket rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1 << 16


def buckets(df: DataFrame, place: Column, span: int) -> Column:
    """The bucket of a place, a double that rises with the key."""
    edges = df.select(place.alias("p")).agg(F.struct(F.min("p").alias("lo"), F.max("p").alias("hi"), F.ceil(F.count("*") / span).alias("n")).alias("e")).scalar()
    share = F.when(edges["hi"] > edges["lo"], (place - edges["lo"]) / (edges["hi"] - edges["lo"])).otherwise(F.lit(0.0))
    return F.least(F.floor(share * edges["n"]), edges["n"] - 1)


def running_sum(df: DataFrame, key: str, value: Column, name: str, within: tuple[str, ...] = (), span: int = SPAN, place: Column | None = None) -> DataFrame:
    """`df` with `name`, the sum of `value` over rows with smaller `key`, 0 for the first; null values count
    as 0. A key is a number, or anything that can be ordered with a `place`, a double that never falls as
    the key rises and is about even over the rows; it is unique within the columns `within`."""
    bucket, partial = f"__bucket_{name}", f"__partial_{name}"
    place = F.col(key).cast("double") if place is None else place
    rows = df.withColumns({bucket: buckets(df, place, span), partial: F.coalesce(value, F.lit(0)).cast("long")})
    before = Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*within, bucket).agg(F.sum(partial).alias("__sum"))
    starts = starts.select(*within, bucket, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*within, bucket).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(name, F.coalesce(F.sum(partial).over(inside), F.lit(0)))
    joined = rows.join(starts, [*within, bucket])
    return joined.select(*df.columns, (F.col(name) + F.col("__start")).alias(name))


def row_rank(df: DataFrame, key: str, name: str, within: tuple[str, ...] = (), span: int = SPAN, place: Column | None = None) -> DataFrame:
    """`df` with `name`, how many rows of the same `within` have a smaller `key`."""
    return running_sum(df, key, F.lit(1), name, within, span, place)


def text_place(df: DataFrame, key: str) -> Column:
    """A place for texts that are ordered by their bytes: six bytes behind what all of them begin with."""
    edges = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    same = lambda n, i: F.when((n == i - 1) & (F.substring("lo", F.lit(1), i) == F.substring("hi", F.lit(1), i)), i).otherwise(n)
    common = edges.select(F.aggregate(F.sequence(F.lit(0), F.least(F.length("lo"), F.length("hi"))), F.lit(-1), same)).scalar()
    rest = F.substring(F.substring(F.col(key), common + 1, F.length(key)).cast("binary"), F.lit(1), F.lit(6))
    return F.conv(F.rpad(F.hex(rest), 12, "0"), 16, 10).cast("double")
