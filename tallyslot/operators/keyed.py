"""Operators on keyed tables: first request per key, change application, look-ups."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyslot.sources.workdir import materialise


def flag_first(df: DataFrame, keys: Iterable[str], unique_id: str, out: str, where: Column | None = None) -> DataFrame:
    """Add ``out``: true on the row with the lowest ``unique_id`` of its key.

    The lowest id per key is a map-side combined minimum, and it is matched back
    on the id itself, so a key that holds very many rows is never sorted or
    gathered. Rows outside ``where`` do not compete and get false.
    """
    rivals = df if where is None else df.where(where)
    first = rivals.groupBy(*keys).agg(F.min(unique_id).alias("_first_id")).select("_first_id")
    joined = df.join(first, F.col(unique_id) == F.col("_first_id"), "left")
    return joined.withColumn(out, F.col("_first_id").isNotNull()).drop("_first_id")


class HotKeys:
    """Values of some key columns that more than ``most`` rows share, each with the number of cuts that it needs.

    Only a table of more than ``most`` rows can have one. Then all key columns are
    counted by one job, combined before the shuffle. Values
    are told apart by their hash: another value of one hash is cut without need,
    which changes no result. There are at most rows / ``most`` of them a key.
    """

    def __init__(self, df: DataFrame, keys: Iterable[Iterable[str]], most: int):
        self.keys, self.any = [tuple(k) for k in keys], set()
        if df.count() <= most:
            return
        named = [
            F.when(_complete(k), F.struct(F.lit(i).alias("i"), F.xxhash64(*k).alias("h"))) for i, k in enumerate(self.keys)
        ]
        counted = df.select(F.explode(F.array_compact(F.array(*named))).alias("k")).groupBy("k.i", "k.h").agg(F.count(F.lit(1)).alias("n"))
        found = counted.where(F.col("n") > most).select("i", "h", F.ceil(F.col("n") / most).cast("int").alias("cuts"))
        self.found = materialise(found, "hot-keys")
        self.any = {r["i"] for r in self.found.select("i").distinct().collect()}

    def of(self, keys: Iterable[str]) -> DataFrame | None:
        """``_h, _cuts`` of the hot values of ``keys``; None when there are none."""
        i = self.keys.index(tuple(keys))
        return self.found.where(F.col("i") == i).select(F.col("h").alias("_h"), F.col("cuts").alias("_cuts")) if i in self.any else None


def _complete(keys: Iterable[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def look_up(
    df: DataFrame, keys: list[str], known: DataFrame, known_keys: list[str], hot: HotKeys | None = None, row_id: str | None = None
) -> DataFrame:
    """``df`` with the other columns of ``known``, NULL where no row of ``known`` has the key.

    ``known`` is grouped by its keys, so it has one row a key, and adaptive
    execution cannot split a join with it. So the values in ``hot`` are cut here:
    their rows are dealt out by ``row_id``, and the row of ``known`` is copied to
    each cut. Rows without a key match nothing and are dealt out as well.
    """
    spread = F.xxhash64(row_id) if row_id else F.xxhash64(*[c for c, t in df.dtypes if "map<" not in t])
    cuts = hot.of(keys) if hot else None
    side = known.select(
        *[F.col(k).cast(df.schema[d].dataType).alias(f"_k{i}") for i, (d, k) in enumerate(zip(keys, known_keys, strict=True))],
        *[c for c in known.columns if c not in known_keys],
    )
    names = [f"_k{i}" for i in range(len(keys))]
    if cuts is None:
        dealt, side = df.withColumn("_cuts", F.lit(1)), side.withColumn("_cut", F.lit(0).cast("long"))
    else:
        dealt = df.withColumn("_h", F.xxhash64(*keys)).join(cuts, "_h", "left").drop("_h")
        side = side.withColumn("_h", F.xxhash64(*names)).join(cuts, "_h", "left").drop("_h")
        side = side.withColumn("_cut", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_cuts"), F.lit(1)).cast("long") - 1)))
        side = side.drop("_cuts")
    cut = F.when(_complete(keys), F.pmod(spread, F.coalesce("_cuts", F.lit(1)).cast("long"))).otherwise(spread)
    dealt = dealt.withColumn("_at", cut).drop("_cuts")
    met = [F.col(k) == F.col(n) for k, n in zip(keys, names, strict=True)] + [F.col("_at") == F.col("_cut")]
    return dealt.join(side, reduce(lambda a, b: a & b, met), "left").drop("_at", "_cut", *names)


def flag_known(
    df: DataFrame, column: str, known: DataFrame, known_key: str, out: str, where: Column | None = None, hot: HotKeys | None = None,
    row_id: str | None = None,
) -> DataFrame:
    """Add ``out``: true when ``column`` occurs among the keys of ``known``, however often it occurs there."""
    keys = known if where is None else known.where(where)
    keys = keys.select(F.col(known_key).alias("_key")).distinct().withColumn("_hit", F.lit(True))
    joined = look_up(df, [column], keys, ["_key"], hot, row_id)
    return joined.withColumn(out, F.coalesce("_hit", F.lit(False))).drop("_hit")


def insert_absent(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Append the rows of ``new`` whose key ``base`` lacks; ``new`` must be unique by key."""
    return base.unionByName(new.join(base, keys, "left_anti"), allowMissingColumns=True)


def apply_changes(base: DataFrame, changes: DataFrame, key: str, op: str = "op") -> DataFrame:
    """New version of ``base`` after one insert, update or delete per key.

    An update may set a column to NULL, so the change row decides by its ``op``
    and not by whether its value is present. Columns that ``changes`` does not
    carry keep their old value. An update or delete of an absent key does nothing.
    """
    carried = [c for c in base.columns if c != key and c in changes.columns]
    chg = changes.select(key, F.col(op).alias("_op"), *[F.col(c).alias(f"_new_{c}") for c in carried])
    old = base.withColumn("_was", F.lit(True))
    both = old.join(chg, key, "full_outer")
    inserted = F.col("_was").isNull() & (F.col("_op") == "add")
    kept = F.col("_was") & (F.coalesce(F.col("_op"), F.lit("")) != "delete")
    takes_new = F.col("_op").isin("add", "update")
    cols = [
        F.when(takes_new, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in carried else F.col(c)
        for c in base.columns
    ]
    return both.where(inserted | kept).select(*cols)


def hot_keys(df: DataFrame, keys: list[str], more_than: int) -> DataFrame:
    """Keys with more than ``more_than`` rows; there are at most rows / ``more_than`` of them."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > more_than).select(*keys)


def split_hot(df: DataFrame, keys: list[str], more_than: int) -> tuple[DataFrame, DataFrame | None]:
    """``(cold, hot)`` rows; ``hot`` is None when no key is hot, which leaves the plain plan.

    The check is one map-side combined count over the key columns. The key list
    has at most rows / ``more_than`` entries; it is written, so Spark knows its
    size and broadcasts it while it is under the session's limit.
    """
    hot = materialise(hot_keys(df, keys, more_than), "hot-keys")
    if hot.isEmpty():
        return df, None
    return df.join(hot, keys, "left_anti"), df.join(hot, keys, "left_semi")
