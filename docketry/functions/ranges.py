"""Whole-number ranges as blocks of powers of two, so that "lies in the range" becomes an equality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOP = 61  # levels: numbers up to 2**61 either way


def dyadic_blocks(low: Column, high: Column) -> Column:
    """``array<struct<level: int, block: bigint>>`` of the fewest aligned blocks that make up ``low`` to ``high``, both included:
    block ``b`` of level ``k`` holds the numbers from ``b * 2**k`` on, ``2**k`` of them.

    At most two blocks a level, so a range of n numbers gives 2 log2 n at most. An empty range gives none; a NULL bound
    gives NULL. Bounds beyond ``2**TOP`` count as that.
    """
    inside = lambda c: F.when(c.isNotNull(), F.greatest(F.least(c.cast("bigint"), F.lit(2**TOP)), F.lit(-(2**TOP))))
    first, end = inside(low), inside(high) + 1
    none = F.array().cast("array<struct<level:int,block:bigint>>")

    def at(level: Column) -> Column:
        # what is left of the range after the lower levels took their ends
        left = F.call_function("shiftright", first + F.call_function("shiftleft", F.lit(1).cast("bigint"), level) - 1, level)
        right = F.call_function("shiftright", end, level)
        block = lambda number: F.struct(level.cast("int").alias("level"), number.alias("block"))
        odd = lambda c: c.bitwiseAND(F.lit(1).cast("bigint")) == 1
        some = left < right
        return F.concat(F.when(some & odd(left), F.array(block(left))).otherwise(none),
                        F.when(some & odd(right), F.array(block(right - 1))).otherwise(none))

    levels = F.sequence(F.lit(0), F.length(F.bin(end - first)) - 1)  # no block is larger than the range
    return F.when(first < end, F.flatten(F.transform(levels, at))).when(first.isNotNull() & end.isNotNull(), none)


def block_at(number: Column, level: Column) -> Column:
    """The block of a level that a number lies in."""
    return F.call_function("shiftright", number.cast("bigint"), level)
