"""Deleting parent rows under the declared references: restrict, cascade or set null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyslot.schema import REFS
from tallyslot.sources.dataset import Dataset


def restricting_keys(ds: Dataset, parent: str) -> DataFrame:
    """``_key``: parent keys that some child row protects from deletion."""
    parts = [
        ds[r.table].where(F.col(r.column).isNotNull()).select(F.col(r.column).alias("_key"))
        for r in REFS
        if r.parent == parent and r.on_delete == "restrict" and r.table in ds
    ]
    if not parts:
        raise ValueError(f"nothing restricts deletes from {parent}")
    return reduce(DataFrame.unionByName, parts).distinct()


def _clear_link(df: DataFrame, column: str, gone: DataFrame, key: str) -> DataFrame:
    """Set ``column`` to NULL where the row it points to is gone."""
    marks = gone.select(F.col(key).alias("_gone"))
    marked = df.join(marks, F.col(column) == F.col("_gone"), "left")
    kept = F.when(F.col("_gone").isNull(), F.col(column)).alias(column)
    return marked.select(*[kept if c == column else F.col(c) for c in df.columns])


def delete_rows(ds: Dataset, parent: str, key: str, gone: DataFrame) -> Dataset:
    """The dataset without the ``gone`` keys; children follow their declared action.

    Keys protected by a restricting child must have been taken out of ``gone``.
    """
    gone = gone.select(key).distinct()
    changed = {parent: ds[parent].join(gone, key, "left_anti")}
    for r in REFS:
        if r.parent != parent or r.table not in ds:
            continue
        child = changed.get(r.table, ds[r.table])
        if r.on_delete == "cascade":
            marks = gone.select(F.col(key).alias("_gone"))
            changed[r.table] = child.join(marks, F.col(r.column) == F.col("_gone"), "left_anti")
        elif r.on_delete == "set_null":
            changed[r.table] = _clear_link(child, r.column, gone, key)
    return ds.replace(**changed)
