"""Running sums and ranks over hot groups, without one task per group.

A window ordered by a key sends a whole group to one task.  Here every row gets a uniform 64-bit key, the key space is
cut into ``buckets`` equal ranges, and the running sum is taken in two levels: a window over the (group, bucket) totals,
whose number is bounded by groups * buckets, and a window within each (group, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_of(key: Column, buckets: int) -> Column:
    """Range bucket of a signed 64-bit ``key``; order of buckets is the order of keys."""
    top = F.shiftrightunsigned(key.bitwiseXOR(F.lit(-(2**63)).cast("long")), 32)
    return F.shiftright(top * F.lit(buckets), 32).cast("int")


def running_sum(df: DataFrame, group: list[str], key: str, tie: str, size: str, buckets: int, out: str = "before") -> DataFrame:
    """Adds ``out``: the sum of ``size`` over the rows of the group that come before the row by (key, tie).

    ``key`` is a long that spreads evenly (a hash).  Rows of one bucket, about 1/buckets of a group, meet in one task.
    Empty input gives no rows; null sizes count as nothing.
    """
    b = "__bucket"
    rows = df.withColumn(b, bucket_of(F.col(key), buckets))
    totals = rows.groupBy(*group, b).agg(F.sum(size).alias("__t"))
    over = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, b, F.coalesce(F.sum("__t").over(over), F.lit(0)).alias("__off"))
    inner = Window.partitionBy(*group, b).orderBy(key, tie).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("__in", F.coalesce(F.sum(size).over(inner), F.lit(0)))
    return local.join(offsets, [*group, b]).withColumn(out, F.col("__off") + F.col("__in")).drop(b, "__off", "__in")
