"""Places of rows in a global order, without gathering a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import cut

_LOCAL = 33  # bits that monotonically_increasing_id() leaves for the place inside a partition


def ranked(df: DataFrame, group: list[str], order: list[str], out: str = "rank", size: str = "size") -> DataFrame:
    """``df`` with the place (from 0) of each row among the rows of its group, by ``order`` (NULLs first), and their number.

    Rows are dealt by ranges of group and order; the few counts a partition has of each group give the offsets. Rows that
    tie stand in any order, and a tie of any size is dealt over several partitions. Group columns must not be NULL. An
    empty table stays empty. ``df`` is read twice (ranges, then rows), so it should be a written one.
    """
    by = [*group, *order, "_tie"]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = cut(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _LOCAL).alias("_part")
    counts = placed.groupBy(*group, part).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_offset"),
                            F.sum("_n").over(Window.partitionBy(*group)).alias(size))
    return placed.withColumn("_part", part).join(offsets, [*group, "_part"]).withColumn(out, F.col("_at") + F.col("_offset")).drop(
        "_part", "_at", "_offset")
