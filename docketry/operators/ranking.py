"""Ranks and running sums inside a group of any size.

A plain window puts a whole group into one task. Here the rows of a group are ranked inside buckets of the leading sort
columns, and the bucket totals, which are few, get the running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, group: list[str], bucket: list[str], order: list[Column], amount: Column, out: str) -> DataFrame:
    """Add the running sum of ``amount`` over ``group``; ``bucket`` columns lead the order, ``order`` ends it."""
    totals = df.groupBy(*group, *bucket).agg(F.sum(amount).alias("__total"))
    before = Window.partitionBy(*group).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"__{c}") for c in group + bucket],
        F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"),
    )
    match = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group + bucket]
    inside = Window.partitionBy(*group, *bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.join(offsets, match, "inner")
        .withColumn(out, F.col("__offset") + F.sum(amount).over(inside))
        .drop("__offset", *[f"__{c}" for c in group + bucket])
    )


def group_rank(df: DataFrame, group: list[str], bucket: list[str], order: list[Column], out: str) -> DataFrame:
    """Add the row number inside ``group``."""
    return running_total(df, group, bucket, order, F.lit(1), out)


def keep_first(df: DataFrame, group: list[str], order: list[Column], count: int = 1) -> DataFrame:
    """The first rows of each group. Spark limits every map task to ``count`` rows per group before the shuffle."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("__rank") <= count).drop("__rank")


def numbered_rows(df: DataFrame, order: list[Column], folder: str) -> DataFrame:
    """``df`` with its row number from 0 (``row``) in the order of all rows. Rows are dealt by ranges, sorted in their task and
    written to ``folder``; only the sizes of the parts are gathered."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed.write.parquet(folder)
    part = F.shiftright("__at", 33)  # what monotonically_increasing_id() puts above the place in a part
    written = df.sparkSession.read.schema(placed.schema).parquet(folder).withColumn("__part", part)
    sizes = written.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))  # one row a part
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__offset"))
    return written.join(F.broadcast(offsets), "__part").withColumn("row", F.col("__at") + F.col("__offset")).drop("__part", "__at", "__offset")
