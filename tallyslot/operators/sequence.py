"""Running totals and dense numbering without gathering rows in one task.

The ordering column must be a non-negative integer that is unique within the
group. Cutting it into slices of ``2**bits`` consecutive values therefore bounds
how many rows one window partition can hold, whatever the data looks like. Slice
totals are summed the same way one level up, and their offsets are added back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 20


def running_sum(
    df: DataFrame, value: Column, order: str, out: str, keys: tuple[str, ...] = (), bits: int = BITS
) -> DataFrame:
    """Add ``out``: inclusive running sum of ``value`` by ``order`` within ``keys``."""
    keys = list(keys)
    sliced = (
        df.withColumn("_value", value)
        .withColumn("_s1", F.shiftright(F.col(order), bits))
        .withColumn("_s2", F.shiftright(F.col(order), 2 * bits))
    )
    inside = Window.partitionBy(*keys, "_s2", "_s1").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = (Window.unboundedPreceding, -1)
    slice_totals = sliced.groupBy(*keys, "_s2", "_s1").agg(F.sum("_value").alias("_t1"))
    block_totals = slice_totals.groupBy(*keys, "_s2").agg(F.sum("_t1").alias("_t2"))
    # At most 2**bits slices per block, and 2**(63 - 2 * bits) blocks in all.
    slice_offsets = slice_totals.withColumn(
        "_o1", F.sum("_t1").over(Window.partitionBy(*keys, "_s2").orderBy("_s1").rowsBetween(*before))
    ).drop("_t1")
    block_window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    block_offsets = block_totals.withColumn(
        "_o2", F.sum("_t2").over(block_window.orderBy("_s2").rowsBetween(*before))
    ).drop("_t2")
    offsets = slice_offsets.join(block_offsets, [*keys, "_s2"]).withColumn(
        "_offset", F.coalesce("_o1", F.lit(0)) + F.coalesce("_o2", F.lit(0))
    )
    return (
        sliced.withColumn("_inside", F.sum("_value").over(inside))
        .join(offsets.select(*keys, "_s2", "_s1", "_offset"), [*keys, "_s2", "_s1"])
        .withColumn(out, F.col("_inside") + F.col("_offset"))
        .drop("_value", "_s1", "_s2", "_inside", "_offset")
    )


def numbered(df: DataFrame, order: str, out: str, start: Column, bits: int = BITS) -> DataFrame:
    """Add ``out``: ``start + 1, start + 2, ...`` in ``order``, which must be unique."""
    counted = running_sum(df, F.lit(1).cast("long"), order, "_n", bits=bits)
    return counted.withColumn(out, F.coalesce(start, F.lit(0)).cast("long") + F.col("_n")).drop("_n")


def exact_percentiles(df: DataFrame, value: str, points: list[float], bits: int = BITS) -> DataFrame:
    """One row with columns ``p0, p1, ...``: interpolated percentiles of a money column.

    Equal values are counted first, so the cost follows the number of distinct
    amounts; the ranks come from a sliced running sum over those counts.
    """
    unit = F.lit(100).cast("decimal(3,0)")
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy((F.col(value) * unit).cast("long").alias("_cents"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    if not points:
        raise ValueError("no percentile points given")
    # Shift so that the order column is never negative.
    low = F.lit(1 << 40)
    ranked = running_sum(counts.withColumn("_order", F.col("_cents") + low), F.col("_n"), "_order", "_upto", bits=bits)
    total = counts.agg(F.sum("_n")).scalar()
    picks, results = [], []
    for i, p in enumerate(points):
        position = F.lit(float(p)) * (total - 1)
        for name, rank in ((f"_lo{i}", F.floor(position)), (f"_hi{i}", F.ceil(position))):
            here = (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
            picks.append(F.max(F.when(here, F.col("_cents"))).alias(name))
        share = position - F.floor(position)
        lo, hi = F.col(f"_lo{i}") / 100, F.col(f"_hi{i}") / 100
        results.append((lo + (hi - lo) * share).alias(f"p{i}"))
    return ranked.agg(*picks).select(*results)
