"""Integrity rules of ``schema.py`` as jobs that report violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyslot import schema
from tallyslot.sources.dataset import Dataset, unreadable


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def duplicate_keys(ds: Dataset) -> DataFrame:
    """Per declared key: how many key values occur more than once, and on how many rows."""
    parts = []
    for table, key in schema.KEYS:
        present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
        counted = ds[table].where(present).groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
        repeated = F.col("_n") > 1
        parts.append(
            counted.agg(
                F.count_if(repeated).alias("repeated_keys"),
                F.coalesce(F.sum(F.when(repeated, F.col("_n"))), F.lit(0)).cast("long").alias("rows_involved"),
            ).select(
                F.lit(table).alias("table_name"), F.lit(", ".join(key)).alias("key_columns"),
                "repeated_keys", "rows_involved",
            )
        )
    return _union(parts)


def orphans(ds: Dataset) -> DataFrame:
    """Per declared reference: rows whose value has no parent row."""
    parts = []
    for r in schema.REFS:
        # Distinct values are counted first, so a value shared by very many rows meets its parent once.
        used = ds[r.table].where(F.col(r.column).isNotNull()).groupBy(F.col(r.column).alias("_v")).agg(
            F.count(F.lit(1)).alias("_n")
        )
        parents = ds[r.parent].select(F.col(r.parent_key).alias("_v"))
        parts.append(
            used.join(parents, "_v", "left_anti")
            .agg(F.count(F.lit(1)).alias("orphan_values"), F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("orphan_rows"))
            .select(
                F.lit(r.table).alias("table_name"), F.lit(r.column).alias("column_name"),
                F.lit(r.parent).alias("parent_table"), F.lit(r.on_delete).alias("on_delete"),
                "orphan_values", "orphan_rows",
            )
        )
    return _union(parts)


def _tally(tables: dict[str, DataFrame], rules: dict[str, list[tuple[str, Column]]], label: str) -> DataFrame:
    """One pass per table that counts the rows breaking each rule, turned into rows."""
    parts = []
    for table, checks in rules.items():
        counts = tables[table].agg(*[F.count_if(broken).alias(f"_c{i}") for i, (_, broken) in enumerate(checks)])
        pairs = [
            F.struct(F.lit(name).alias(label), F.col(f"_c{i}").alias("rows_broken"))
            for i, (name, _) in enumerate(checks)
        ]
        parts.append(
            counts.select(F.explode(F.array(*pairs)).alias("_p")).select(
                F.lit(table).alias("table_name"), f"_p.{label}", "_p.rows_broken"
            )
        )
    return _union(parts)


def nulls(ds: Dataset) -> DataFrame:
    """Stored NULLs of required columns, also of those whose default the loader fills in; a column that the stored
    table lacks has only defaults."""
    tables = {table: ds.stored(table) for table in schema.TABLES}
    rules = {
        table: [(c.name, F.col(c.name).isNull() if c.name in tables[table].columns else F.lit(False)) for c in cols if c.required]
        for table, cols in schema.TABLES.items()
    }
    return _tally(tables, rules, "column_name")


def checks(ds: Dataset) -> DataFrame:
    """Row checks; a check that comes out NULL passes."""
    rules: dict[str, list[tuple[str, Column]]] = {}
    for table, name, condition in schema.CHECKS:
        rules.setdefault(table, []).append((name, ~F.coalesce(F.expr(condition), F.lit(True))))
    return _tally({table: ds[table] for table in rules}, rules, "check_name")


def lengths(ds: Dataset) -> DataFrame:
    """Stored text over its length limit and stored money outside ten digits."""
    tables, rules = {table: ds.stored(table) for table in schema.TABLES}, {}
    for table, cols in schema.TABLES.items():

        def broken(c: schema.Col, rule: Column, there=tables[table].columns) -> Column:
            return rule if c.name in there else F.lit(False)

        found = [(f"{c.name} <= {c.length}", broken(c, F.length(c.name) > c.length)) for c in cols if c.length]
        found += [(f"{c.name} < 10^8", broken(c, unreadable(c))) for c in cols if c.type == schema.MONEY]
        if found:
            rules[table] = found
    return _tally(tables, rules, "limit_rule")
