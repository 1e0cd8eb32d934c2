"""Running totals over a whole ordering without putting a whole ordering into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bispace.session import work_table


def dealt(df: DataFrame, key: str, most: int) -> tuple[DataFrame, int]:
    """``df`` dealt by a hash of ``key`` into parts of about ``most`` rows, and their number.

    Sums by the key then need no more memory in a task than such a part takes; adaptive execution, which
    goes by compressed bytes, doesn't merge parts whose number is given.
    """
    parts = max(1, -(-df.count() // most))
    return df.repartition(parts, key), parts


def placed(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` in ranges of (keys, order), each row with its range number ``_p``.

    Written once: ranges come from a sample, so another evaluation could cut elsewhere.
    """
    return work_table(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_p", F.spark_partition_id()), "ranges")


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its key up to and with its own.

    Each range sums its own rows; totals of the ranges before it, one row a range and key, are added.
    Rows that tie in ``order`` share a sum only if they are one row, so order by something unique.
    """
    rows = placed(df.withColumn("_v", value), keys, order)
    totals = rows.groupBy(*keys, "_p").agg(F.sum("_v").alias("_t"))
    before = F.coalesce(F.sum("_t").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.withColumn("_b", before).drop("_t")
    own = F.sum("_v").over(Window.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(offsets if keys else F.broadcast(offsets), [*keys, "_p"]).withColumn(out, own + F.col("_b")).drop("_v", "_b", "_p")


def least_from_here(df: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """``df`` with the least ``value`` of the rows from its own to the end of the ordering."""
    rows = placed(df, [], order)
    ends = rows.groupBy("_p").agg(F.min(value).alias("_t"))
    after = F.min("_t").over(Window.orderBy("_p").rowsBetween(1, Window.unboundedFollowing))  # one row a range
    offsets = ends.withColumn("_a", after).drop("_t")
    own = F.min(value).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(0, Window.unboundedFollowing))
    return rows.join(F.broadcast(offsets), "_p").withColumn(out, F.least(own, "_a")).drop("_a", "_p")
