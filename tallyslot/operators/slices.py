"""Ordered histories of hot keys, cut into slices of a bounded number of rows."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyslot.sources.workdir import materialise


def cut_by_rank(rows: DataFrame, key: str, order: list[str], most: int, label: str) -> DataFrame:
    """``rows`` with ``_slice``: consecutive rows of a key's order, at most ``most`` of them.

    ``order`` ends with a unique id, so that also rows of one instant can be
    told apart and cut. Spark draws the splitters from a sample of the order; the
    slices are written, their sizes counted, and the cut is made finer until the
    largest one holds ``most`` rows.
    """
    parts = max(1, ceil(2 * rows.count() / most))
    while True:
        cut = rows.repartitionByRange(parts, key, *order).withColumn("_slice", F.spark_partition_id())
        cut = materialise(cut, label)
        largest = cut.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if (largest or 0) <= most:
            return cut
        parts *= 2
