"""Balances that never go below zero: ``b = max(0, b + change)`` step by step.

With ``s`` the opening balance plus the running sum, the clamped balance is
``s - min(0, lowest s so far)``. That turns the step-by-step rule into two
running aggregates, and lets a run of steps be summarised by its sum and its
lowest point, so a long history can be cut into slices and stitched together.
The opening balance only shifts both numbers, so it is joined at the end and the
steps go through one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyslot.operators.keyed import hot_keys
from tallyslot.operators.slices import cut_by_rank
from tallyslot.settings import Scale
from tallyslot.sources.workdir import materialise

WIDE = "decimal(28,2)"


def _zero() -> Column:
    return F.lit(0).cast(WIDE)


def _with_opening(rows: DataFrame, key: str, openings: DataFrame | None) -> DataFrame:
    """Turn relative sum and lowest point into the balance; no opening means zero."""
    start = _zero()
    if openings is not None:
        rows, start = rows.join(openings, key), F.col("opening").cast(WIDE)
    lowest = start + F.col("_lowest")
    balance = (start + F.col("_total") - F.least(_zero(), lowest)).cast(WIDE)
    return rows.withColumn("balance", balance).drop("_total", "_lowest")


def _plain(steps: DataFrame, key: str, order: list[str]) -> DataFrame:
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = steps.withColumn("_total", F.sum("change").over(upto).cast(WIDE))
    return summed.withColumn("_lowest", F.min("_total").over(upto))


def _sliced(steps: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The same two columns with every window bounded to a slice of ``most`` steps.

    A slice passes on its sum and its lowest point; those of a key are chained,
    and there are only steps / ``most`` of them.
    """
    rows = cut_by_rank(steps, key, order, most, "balance-slices")
    inside = Window.partitionBy(key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum("change").over(inside).cast(WIDE))
    rows = rows.withColumn("_low", F.min("_sum").over(inside))
    slices = rows.groupBy(key, "_slice").agg(F.sum("change").cast(WIDE).alias("_all"), F.min("_low").alias("_least"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_off", F.coalesce(F.sum("_all").over(before), _zero()))
    slices = slices.withColumn("_point", F.col("_off") + F.col("_least"))
    offsets = slices.select(key, "_slice", "_off", F.min("_point").over(before).alias("_off_low"))
    return (
        rows.join(offsets, [key, "_slice"])
        .withColumn("_total", (F.col("_off") + F.col("_sum")).cast(WIDE))
        .withColumn("_lowest", F.least("_off_low", F.col("_off") + F.col("_low")).cast(WIDE))
        .drop("_slice", "_sum", "_low", "_off", "_off_low")
    )


def running_balance(
    steps: DataFrame, key: str, order: list[str], openings: DataFrame | None = None, scale: Scale = Scale()
) -> DataFrame:
    """Add ``balance`` after every step, and ``opening`` if ``openings`` (``key, opening``) is given.

    ``steps`` carries ``change``; ``order`` ends with a unique id. Keys with more
    than ``scale.hot_rows`` steps take the sliced form, with slices of at most so
    many steps.
    """
    hot = hot_keys(steps, [key], scale.hot_rows)
    if hot.isEmpty():
        return _with_opening(_plain(steps, key, order), key, openings)
    hot = materialise(hot, "balance-hot")
    cold_rows = _with_opening(_plain(steps.join(hot, key, "left_anti"), key, order), key, openings)
    hot_openings = None if openings is None else openings.join(hot, key, "left_semi")
    hot_rows = _sliced(steps.join(hot, key, "left_semi"), key, order, scale.hot_rows)
    return cold_rows.unionByName(_with_opening(hot_rows, key, hot_openings))


def final_balance(
    steps: DataFrame, key: str, order: list[str], openings: DataFrame, scale: Scale = Scale()
) -> DataFrame:
    """Balance of each key after all its steps: ``key, opening, balance``."""
    done = running_balance(steps, key, order, openings, scale)
    return done.groupBy(key).agg(
        F.first("opening").alias("opening"), F.max_by("balance", F.struct(*order)).alias("balance")
    )


def charge_only(steps: DataFrame, key: str, openings: DataFrame) -> DataFrame:
    """``final_balance`` when no change goes up: clamping once equals clamping each step.

    The changes are summed before they meet the openings.
    """
    sums = steps.groupBy(key).agg(F.sum("change").alias("_sum"))
    balance = F.greatest(_zero(), F.col("opening").cast(WIDE) + F.col("_sum")).cast(WIDE)
    return sums.join(openings, key).select(key, "opening", balance.alias("balance"))
