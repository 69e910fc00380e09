"""Who gets a slot: ordered first-come-first-served settlement of booking requests.

A request names a (date, time) and optionally a staff member and a vehicle. It is
free to go ahead when no accepted request before it in the same (date, time)
holds the same staff member or the same vehicle, so each answer depends on
earlier answers through two resources.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyslot.operators.keyed import HotKeys, look_up
from tallyslot.settings import Scale
from tallyslot.sources.workdir import materialise

SLOT = ["lesson_date", "lesson_time_sec"]
#: Rounds go on while each settles at least this share of the open candidates.
LEAST_GAIN = 1 / 16


def slot_key() -> Column:
    """Seconds since 1970 of the slot: one comparable number for (date, time)."""
    return F.unix_date("lesson_date").cast("long") * 86_400 + F.col("lesson_time_sec")


def slot_counts(lessons: DataFrame, resource: str, cancelled: str) -> DataFrame:
    """``resource, _slot, _holders``: how many stored lessons hold each slot."""
    return (
        lessons.where(F.col(resource).isNotNull() & (F.col("lesson_status_code") != cancelled))
        .groupBy(resource, slot_key().alias("_slot"))
        .agg(F.count(F.lit(1)).alias("_holders"))
    )


def with_holders(
    df: DataFrame, lessons: DataFrame, resource: str, cancelled: str, out: str, of: str | None = None, at: str = "_slot",
    hot: HotKeys | None = None, row_id: str | None = None,
) -> DataFrame:
    """Add ``out``: number of stored, not cancelled lessons in this row's slot of ``resource``.

    The stored side is counted first and so has one row per slot. ``df`` must
    carry the slot in ``at`` and the resource in ``of`` (by default of its own
    name); slots in ``hot`` are split.
    """
    counts = slot_counts(lessons, resource, cancelled)
    met = look_up(df, [of or resource, at], counts, [resource, "_slot"], hot, row_id)
    return met.withColumn(out, F.coalesce("_holders", F.lit(0).cast("long"))).drop("_holders")


def _winners_in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk candidates sorted by slot and id, holding only the current slot's taken sets."""
    slot, staff, vehicles = None, set(), set()
    for pdf in batches:
        won = []
        for here, s, v in zip(pdf["_slot"].tolist(), pdf["staff_id"].tolist(), pdf["vehicle_id"].tolist()):
            if here != slot:
                slot, staff, vehicles = here, set(), set()
            free = s not in staff and v not in vehicles
            won.append(free)
            if free:
                if s >= 0:
                    staff.add(s)
                if v >= 0:
                    vehicles.add(v)
        yield pdf[won]


def _ordered_pass(candidates: DataFrame) -> DataFrame:
    """Slots go to tasks whole; inside a task they stream by in request order."""
    placed = candidates.repartition("_slot").sortWithinPartitions("_slot", "request_id")
    return placed.mapInPandas(_winners_in_order, candidates.schema)


def _rounds(candidates: DataFrame, scale: Scale) -> DataFrame:
    """The same winners, found without placing a large slot in one task.

    A candidate that is the earliest open one both for its staff member and for
    its vehicle wins; the open candidates it blocks drop out; repeat. Minima are
    combined before the shuffle. What is open does not depend on the winners so
    far, so the ordered pass takes over once no more than ``hot_slot_pairs`` are
    open, or once a round settles so few (a chain in which each candidate waits
    for the one before it) that rounds would go on for as long as the chain. The
    number of rounds thus grows with the logarithm of the candidates at most.
    """
    opened, won_parts = materialise(candidates, "slot-open"), []
    n_open = opened.count()
    while True:
        if n_open <= scale.hot_slot_pairs:
            won_parts.append(_ordered_pass(opened))
            break
        marked = opened
        for resource in ("staff_id", "vehicle_id"):
            lead = (
                opened.where(F.col(resource) >= 0)
                .groupBy("_slot", resource)
                .agg(F.min("request_id").alias(f"_lead_{resource}"))
            )
            marked = marked.join(lead, ["_slot", resource], "left")
        leads = [F.coalesce(f"_lead_{r}", "request_id") == F.col("request_id") for r in ("staff_id", "vehicle_id")]
        won = materialise(marked.where(leads[0] & leads[1]).select(*candidates.columns), "slot-won")
        won_parts.append(won)
        rest = opened.join(won, "request_id", "left_anti")
        for resource in ("staff_id", "vehicle_id"):
            held = won.where(F.col(resource) >= 0).select("_slot", resource)
            rest = rest.join(held, ["_slot", resource], "left_anti")
        opened = materialise(rest.select(*candidates.columns), "slot-open")
        left = opened.count()
        if left > (1 - LEAST_GAIN) * n_open:
            won_parts.append(_ordered_pass(opened))
            break
        n_open = left
    return reduce(DataFrame.unionByName, won_parts)


def _winners(requests: DataFrame, scale: Scale) -> DataFrame:
    """Accepted requests as ``request_id, _slot, staff_id, vehicle_id`` (-1 for none)."""
    # Of the requests for one staff and vehicle pair in a slot only the first can win, so the
    # number of candidates is bounded by the pairs and a flood of equal requests collapses here.
    candidates = (
        requests.where("takes_slot")
        .groupBy(
            "_slot",
            F.coalesce("staff_id", F.lit(-1)).alias("staff_id"),
            F.coalesce("vehicle_id", F.lit(-1)).alias("vehicle_id"),
        )
        .agg(F.min("request_id").alias("request_id"))
        .where("staff_id >= 0 OR vehicle_id >= 0")
    )
    big = candidates.groupBy("_slot").agg(F.count(F.lit(1)).alias("_pairs")).where(F.col("_pairs") > scale.hot_slot_pairs)
    if big.isEmpty():
        return _ordered_pass(candidates)
    candidates = materialise(candidates, "slot-candidates")
    hot = materialise(big.select("_slot"), "slot-hot")  # at most candidates / hot_slot_pairs rows
    cold_winners = _ordered_pass(candidates.join(hot, "_slot", "left_anti"))
    return cold_winners.unionByName(_rounds(candidates.join(hot, "_slot", "left_semi"), scale))


def settle(requests: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """Add ``slot_conflict``: ``staff_conflict``, ``vehicle_conflict`` or NULL.

    ``requests`` holds ``request_id, _slot, staff_id, vehicle_id, takes_slot``;
    a request that does not take its slot (say, for a bad price) is still told
    about conflicts but blocks nobody. A slot has at most one winner per staff
    member and per vehicle, so every request meets at most two winner rows.
    """
    winners = _winners(requests, scale)
    out = requests
    for resource in ("staff_id", "vehicle_id"):
        first = winners.where(F.col(resource) >= 0).select(
            "_slot", resource, F.col("request_id").alias(f"_won_{resource}")
        )
        out = out.join(first, ["_slot", resource], "left")
    return out.withColumn(
        "slot_conflict",
        F.when(F.col("_won_staff_id") < F.col("request_id"), "staff_conflict").when(
            F.col("_won_vehicle_id") < F.col("request_id"), "vehicle_conflict"
        ),
    ).drop("_won_staff_id", "_won_vehicle_id")
