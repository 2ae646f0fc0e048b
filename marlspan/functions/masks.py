"""Masks as bit maps: 64 pixels to a number, row by row from the lowest bit; overlaps are counts of bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(flags: Column | str) -> Column:
    """An array of booleans as an array of 64-bit numbers; null flags are not set."""
    flags = F.col(flags) if isinstance(flags, str) else flags

    def number(k: Column) -> Column:
        bits = F.transform(F.slice(flags, 64 * k + 1, F.lit(64)), lambda x, i: F.call_function("shiftleft", F.coalesce(x.cast("long"), F.lit(0).cast("long")), i))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    n = F.ceil(F.size(flags) / 64).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), number)).otherwise(F.array().cast("array<bigint>"))


def _count(numbers: Column) -> Column:
    return F.aggregate(F.transform(numbers, lambda x: F.bit_count(x).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)


def area(mask: Column | str) -> Column:
    return _count(F.col(mask) if isinstance(mask, str) else mask)


def intersection(a: Column | str, b: Column | str) -> Column:
    return _count(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))


def union(a: Column | str, b: Column | str) -> Column:
    return _count(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)))


def iou(a: Column | str, b: Column | str) -> Column:
    """Shared pixels by all pixels of two masks of one shape; null if both are empty."""
    return F.try_divide(intersection(a, b).cast("double"), union(a, b))


def best_matches(masks: DataFrame, references: DataFrame, keys: list[str], who: str) -> DataFrame:
    """keys, matched, iou, status of each reference (keys, mask, height, width): of the masks (keys, who, mask, height, width) of its shape the one of largest iou, the smallest `who` among equals.

    Where none has the shape, or all are as empty as the reference, there is no match, and the status says so.  An equi join on the keys, and as many rows as
    there are masks; the argmax is one aggregation.
    """
    shape = ["height", "width"]
    other = masks.select(*keys, *shape, who, F.col("mask").alias("__mask"))
    both = references.select(*keys, *shape, "mask").join(other, [*keys, *shape], "left").withColumn("__iou", iou("mask", "__mask"))
    best = both.groupBy(*keys).agg(F.min(F.when(F.col("__iou").isNotNull(), F.struct((-F.col("__iou")).alias("less"), F.col(who).alias("who")))).alias("best"))
    return best.select(*keys, F.col("best.who").alias("matched"), (-F.col("best.less")).alias("iou"), F.when(F.col("best").isNotNull(), "ok").otherwise("no object overlaps").alias("status"))
