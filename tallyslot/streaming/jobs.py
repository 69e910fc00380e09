"""Streams over payments, lesson changes, sign-ins and bookings.

Where a running sum can express the rule, the stream is a built-in aggregation.
The ordered rules keep a small state per key; the rows a call sees for one key
are bounded by what a trigger admits.
"""

from __future__ import annotations

import calendar
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyslot import settings as S
from tallyslot.functions import exprs as X
from tallyslot.operators import slots
from tallyslot.plans.accounts import is_reset, with_account
from tallyslot.settings import Clock
from tallyslot.sources.dataset import Dataset
from tallyslot.streaming.runner import drain, kept

NO_TIMEOUT = GroupStateTimeout.NoTimeout


def _rows(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """A key's rows of one trigger, in order."""
    return pd.concat(batches, ignore_index=True).sort_values(order, kind="stable")


# --- payments ----------------------------------------------------------------
def stream_balance(ds: Dataset) -> DataFrame:
    """Balances kept by a payment stream: ``customer_id, opening, balance``.

    Every payment subtracts and the balance stops at zero. As all steps go down,
    that equals the opening balance minus the sum, stopped at zero once, so the
    state is a sum and partial sums are combined before the shuffle.
    """
    sums = ds.payments.groupBy("customer_id").agg(F.sum("amount_payment").alias("paid"))
    opening = ds.customers.select("customer_id", F.col("amount_outstanding").alias("opening"))
    zero = F.lit(0).cast("decimal(28,2)")

    def finish(batch: DataFrame) -> DataFrame:
        left = F.greatest(zero, F.col("opening") - F.col("paid")).cast("decimal(28,2)")
        return batch.join(opening, "customer_id").select("customer_id", "opening", left.alias("balance"))

    return kept(sums, "stream-balance", ["customer_id"], finish)


def stream_monthly_revenue(ds: Dataset) -> DataFrame:
    """Monthly revenue by method, kept live: ``pay_month, method, num_payments, total_collected``."""
    sums = ds.payments.groupBy(X.month_text("datetime_payment").alias("pay_month"), "payment_method_code").agg(
        F.count(F.lit(1)).alias("num_payments"), F.sum("amount_payment").alias("total_collected")
    )
    methods = ds.payment_methods

    def finish(batch: DataFrame) -> DataFrame:
        return batch.join(methods, "payment_method_code").select(
            "pay_month", F.col("payment_method_description").alias("method"), "num_payments", "total_collected"
        )

    return kept(sums, "stream-revenue", ["pay_month", "method"], finish)


# --- lesson changes ----------------------------------------------------------
BLOCK_BITS = 7


def _audit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """``state``: last status of each of the 128 lessons of a block, by position."""
    rows = pd.concat(batches, ignore_index=True)
    last = list(state.get[0]) if state.exists else [None] * (1 << BLOCK_BITS)
    changes = []
    for lesson, version, status in sorted(zip(rows["lesson_id"], rows["version"], rows["lesson_status_code"])):
        place = lesson & ((1 << BLOCK_BITS) - 1)
        before, last[place] = last[place], status
        if before is not None and status != before:
            changes.append((lesson, version, before, status, "system"))
    state.update((last,))
    if changes:
        yield pd.DataFrame(changes, columns=["lesson_id", "version", "old_status", "new_status", "changed_by"])


def stream_lesson_audit(versions: DataFrame) -> DataFrame:
    """Audit rows of a stream of lesson versions; versions of a lesson arrive in order.

    A state entry covers a block of neighbouring lesson ids: calling into Python
    once per lesson would cost more than the work, and a block stays small.
    """
    audit = (
        versions.withColumn("_block", F.shiftright("lesson_id", BLOCK_BITS))
        .groupBy("_block")
        .applyInPandasWithState(
            _audit,
            "lesson_id long, version long, old_status string, new_status string, changed_by string",
            "statuses array<string>",
            "append",
            NO_TIMEOUT,
        )
    )
    return drain(audit, "stream-audit", "append").drop("batch_id")


# --- sign-ins ----------------------------------------------------------------
def _lockout(after: int, lock: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _rows(batches, ["at", "attempt_id"])
        failures, until = state.get if state.exists else (int(rows["failures_in"].iloc[0]), int(rows["locked_in"].iloc[0]))
        detail = []
        for at, good, reset in zip(rows["at"].tolist(), rows["password_ok"].tolist(), rows["reset"].tolist()):
            if reset:
                failures, until = 0, -1
                detail.append("reset")
            elif until > at:
                detail.append("locked")
            elif good:
                failures, until = 0, -1
                detail.append("ok")
            else:
                failures += 1
                until = at + lock if failures >= after else until
                detail.append("bad password")
        state.update((failures, until))
        yield pd.DataFrame({"attempt_id": rows["attempt_id"], "email": rows["email"], "detail": detail})

    return run


def stream_login_lockout(ds: Dataset, attempts: DataFrame, lock_minutes: int = S.LOCK_MINUTES) -> DataFrame:
    """``attempt_id, email, detail`` of a sign-in stream; attempts of an e-mail arrive in order.

    Rows with a true ``reset`` set a new password and get no answer.
    """
    rows = with_account(ds, attempts)
    ruled = (
        rows.where(F.col("user_id").isNotNull() & (F.col("is_active") | is_reset(rows)))
        .select(
            "attempt_id", "email", X.micros("attempted_at").alias("at"), "password_ok", is_reset(rows).alias("reset"), "failures_in", "locked_in"
        )
        .groupBy("email")
        .applyInPandasWithState(
            _lockout(S.LOCK_AFTER_FAILURES, lock_minutes * 60_000_000),
            "attempt_id long, email string, detail string",
            "failures long, locked_until long",
            "append",
            NO_TIMEOUT,
        )
    )
    shut = F.when(F.col("user_id").isNull(), "no such user").when(~F.col("is_active"), "inactive")
    others = rows.withColumn("detail", shut).where(F.col("detail").isNotNull() & ~is_reset(rows))
    answers = ruled.where("detail <> 'reset'").unionByName(others.select("attempt_id", "email", "detail"))
    return drain(answers, "stream-lockout", "append").drop("batch_id")


# --- bookings ----------------------------------------------------------------
def _book(as_of: int, expire: bool):
    """``as_of``: seconds since 1970. With ``expire`` a slot's state goes once the slot has passed."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        yield _settle_slot(batches, state)
        if expire:
            state.setTimeoutDuration(max(1, int(key[0]) - as_of) * 1000)

    return run


def _settle_slot(batches: Iterator[pd.DataFrame], state: GroupState) -> pd.DataFrame:
    rows = _rows(batches, ["request_id"])
    staff, vehicles = (set(state.get[0]), set(state.get[1])) if state.exists else (set(), set())
    reasons = []
    for s, v, s_held, v_held, good in zip(
        rows["staff_id"].tolist(), rows["vehicle_id"].tolist(), rows["staff_held"].tolist(),
        rows["vehicle_held"].tolist(), rows["good_price"].tolist(),
    ):
        if s_held or s in staff:
            reasons.append("staff_conflict")
        elif v_held or v in vehicles:
            reasons.append("vehicle_conflict")
        elif not good:
            reasons.append("price_invalid")
        else:
            reasons.append(None)
            if s >= 0:
                staff.add(s)
            if v >= 0:
                vehicles.add(v)
    state.update((sorted(staff), sorted(vehicles)))
    return pd.DataFrame({"request_id": rows["request_id"], "reason": pd.Series(reasons, dtype=object, index=rows.index)})


def booking_answers(ds: Dataset, requests: DataFrame, clock: Clock, expire: bool = False) -> DataFrame:
    """The streaming plan ``request_id, reason``; requests arrive in request order.

    State per slot is the staff and vehicles taken, at most one entry each. The
    checks against stored tables are stream-static joins. A stream that runs on
    sets ``expire``; one that stops at the end of its input must not, because a
    pending timeout keeps it running.
    """
    today = F.lit(clock.date)
    active = ds.customers.where("customer_status_code = 'ACT'").select(
        F.col("customer_id"), F.lit(True).alias("_customer")
    )
    staff = ds.staff.select("staff_id", F.lit(True).alias("_staff"))
    vehicles = ds.vehicles.select("vehicle_id", F.lit(True).alias("_vehicle"))
    over = (F.col("lesson_date") == today) & (F.col("lesson_time_sec") <= clock.second_of_day)
    rows = (
        requests.join(active, "customer_id", "left")
        .join(staff, "staff_id", "left")
        .join(vehicles, "vehicle_id", "left")
        .withColumn(
            "reason",
            X.first_failure(
                [
                    ("date_time_required", F.col("lesson_date").isNull() | F.col("lesson_time_sec").isNull()),
                    ("customer_not_active", F.col("_customer").isNull()),
                    ("staff_missing", F.col("staff_id").isNotNull() & F.col("_staff").isNull()),
                    ("vehicle_missing", F.col("vehicle_id").isNotNull() & F.col("_vehicle").isNull()),
                    ("in_past", (F.col("lesson_date") < today) | over),
                ]
            ),
        )
        .withColumn("_slot", slots.slot_key())
    )
    rejected = rows.where(F.col("reason").isNotNull()).select("request_id", "reason")
    open_rows = rows.where(F.col("reason").isNull())
    for resource, out in (("staff_id", "_s"), ("vehicle_id", "_v")):
        open_rows = slots.with_holders(open_rows, ds.lessons, resource, S.CANCELLED, out)
    none = F.lit(-1).cast("long")
    settled = (
        open_rows.select(
            "_slot",
            "request_id",
            F.coalesce("staff_id", none).alias("staff_id"),
            F.coalesce("vehicle_id", none).alias("vehicle_id"),
            (F.col("_s") > 0).alias("staff_held"),
            (F.col("_v") > 0).alias("vehicle_held"),
            F.coalesce(F.col("price") >= 0, F.lit(False)).alias("good_price"),
        )
        .groupBy("_slot")
        .applyInPandasWithState(
            _book(calendar.timegm(clock.as_of.timetuple()), expire),
            "request_id long, reason string",
            "staff array<long>, vehicles array<long>",
            "append",
            GroupStateTimeout.ProcessingTimeTimeout if expire else NO_TIMEOUT,
        )
    )
    return settled.unionByName(rejected)


def stream_booking(ds: Dataset, requests: DataFrame, clock: Clock) -> DataFrame:
    """``request_id, ok, reason`` of all bookings that have arrived."""
    answers = drain(booking_answers(ds, requests, clock), "stream-booking", "append")
    return answers.select("request_id", F.col("reason").isNull().alias("ok"), "reason")
