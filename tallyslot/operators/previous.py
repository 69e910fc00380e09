"""Previous value of a versioned row, with hot keys cut into bounded slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyslot.settings import Scale


def with_previous(df: DataFrame, key: str, version: str, value: str, out: str, scale: Scale = Scale()) -> DataFrame:
    """Add ``out``: ``value`` of the row with the next lower ``version`` of the same key.

    ``version`` is a non-negative integer, unique per key. A window covers at
    most ``2**slice_bits`` versions. The first row of a later slice takes the
    last value of the slice before it; in ordinary data no version reaches a
    second slice, the carried table is empty, and Spark drops the join.
    """
    bits = scale.slice_bits
    rows = df.withColumn("_slice", F.shiftright(F.col(version), bits))
    inside = Window.partitionBy(key, "_slice").orderBy(version)
    rows = rows.withColumn("_prev", F.lag(value).over(inside)).withColumn("_n", F.row_number().over(inside))

    # Filtering on the raw column lets the parquet reader skip row groups.
    late = df.where(F.col(version) >= (1 << bits)).select(key).distinct()
    lasts = (
        df.join(late, key, "left_semi")
        .groupBy(key, F.shiftright(F.col(version), bits).alias("_slice"))
        .agg(F.max_by(value, version).alias("_last"))
        .withColumn("_carried", F.lag("_last").over(Window.partitionBy(key).orderBy("_slice")))
        .select(key, "_slice", "_carried")
    )
    joined = rows.join(lasts, [key, "_slice"], "left")
    return joined.withColumn(
        out, F.when(F.col("_n") == 1, F.col("_carried")).otherwise(F.col("_prev"))
    ).drop("_slice", "_prev", "_n", "_carried")
