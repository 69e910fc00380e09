"""Payment jobs: recording, correction and the balances that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyslot.functions import exprs as X
from tallyslot.operators.balance import charge_only, final_balance, running_balance
from tallyslot.operators.keyed import HotKeys, flag_first, flag_known, look_up
from tallyslot.operators.replay import State, replay, sharing
from tallyslot.settings import Scale
from tallyslot.sources.dataset import Dataset
from tallyslot.sources.workdir import materialise


def _note(df: DataFrame) -> Column:
    """The note that requests may carry in ``details``."""
    return F.col("details") if "details" in df.columns else F.lit(None).cast("string")


def record(ds: Dataset, requests: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """Answer payment requests: adds ``ok, reason``.

    A customer can have one payment per instant. A request that repeats a stored
    instant, or that of an earlier accepted request, is a duplicate key.
    """
    hot = HotKeys(requests, [["customer_id"], ["customer_id", "datetime_payment"]], scale.hot_rows)
    rows = flag_known(requests, "customer_id", ds.customers, "customer_id", "_customer", None, hot, "request_id")
    rows = flag_known(rows, "payment_method_code", ds.payment_methods, "payment_method_code", "_method", row_id="request_id")
    stored = ds.payments.select("customer_id", "datetime_payment").distinct().withColumn("_stored", F.lit(True))
    key = ["customer_id", "datetime_payment"]
    rows = look_up(rows, key, stored, key, hot, "request_id")
    rows = rows.withColumn(
        "_fail",
        X.first_failure(
            [
                ("customer_missing", ~F.col("_customer")),
                ("method_unknown", ~F.col("_method")),
                ("amount_not_positive", F.col("amount") <= 0),
                ("amount_null", F.col("amount").isNull()),
                ("duplicate_key", F.col("_stored").isNotNull()),
            ]
        ),
    )
    rows = flag_first(
        rows, ["customer_id", "datetime_payment"], "request_id", "_first", where=F.col("_fail").isNull()
    )
    reason = F.when(F.col("_fail").isNotNull(), F.col("_fail")).when(~F.col("_first"), "duplicate_key")
    return rows.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull()).select(
        *requests.columns, "ok", "reason"
    )


def recorded_payments(answered: DataFrame) -> DataFrame:
    """The payment rows that accepted requests create, with their notes."""
    return answered.where("ok").select(
        "customer_id", "datetime_payment", "payment_method_code", F.col("amount").alias("amount_payment"),
        _note(answered).alias("other_payment_details"),
    )


def _opening(ds: Dataset) -> DataFrame:
    return ds.customers.select("customer_id", F.col("amount_outstanding").alias("opening"))


def payment_balances(ds: Dataset, answered: DataFrame, double_apply: bool = True) -> DataFrame:
    """Balances after the accepted payments.

    The live system subtracts a payment twice, once on recording and once in an
    insert trigger. ``double_apply=False`` subtracts it once.
    """
    times = -2 if double_apply else -1
    steps = answered.where("ok").select("customer_id", (F.col("amount") * F.lit(times)).alias("change"))
    return charge_only(steps, "customer_id", _opening(ds))


def balance_steps(ds: Dataset) -> DataFrame:
    """Charges and payments as one history of signed steps, from a zero balance."""
    charges = ds.lessons.select(
        "customer_id", X.lesson_stamp().alias("step_at"), F.lit("lesson").alias("kind"), F.col("lesson_id").alias("ref"),
        F.col("price").cast("decimal(12,2)").alias("change"),
    )
    paid = ds.payments.select(
        "customer_id", F.col("datetime_payment").alias("step_at"), F.lit("payment").alias("kind"),
        X.micros("datetime_payment").alias("ref"), (-F.col("amount_payment")).cast("decimal(12,2)").alias("change"),
    )
    return charges.unionByName(paid)


def running_balances(steps: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """Balance of each customer after every step."""
    return running_balance(steps, "customer_id", ["step_at", "kind", "ref"], scale=scale)


class _Corrections:
    """A correction against the payments that the requests before it left.

    A key is a customer's instant; its value is the amount paid there and the
    instant under which that payment is stored, or NULL where there is no payment.
    """

    answer = "reason string, old_amount string, stored_at string"

    @staticmethod
    def _keys(ask: dict) -> list[str]:
        return [f"{ask['customer']}@{ask[c]}" for c in ("here", "there")]

    def held(self, ask: dict) -> list[tuple[str, str | None]]:
        paid = [f"{ask[n]}|{ask[c]}" if ask[n] is not None else None for n, c in (("here_paid", "here"), ("there_paid", "there"))]
        return list(zip(self._keys(ask), paid, strict=True))

    def step(self, state: State, ask: dict) -> tuple:
        here, there = self._keys(ask)
        if state[here] is None:
            return "payment_not_found", None, None
        if ask["amount"] is None:
            return "amount_null", None, None
        if there != here and state[there] is not None:
            return "duplicate_key", None, None
        old, stored = state[here].split("|")
        state[here] = None
        state[there] = f"{ask['amount']}|{stored}"
        return None, old, stored

    def leads_to(self, key: str, value: str | None) -> list[str]:
        return []


def correct(ds: Dataset, requests: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """Answer payment corrections in request order: adds ``ok, reason, old_amount, stored_datetime``.

    The answers are those of handling the requests one by one: a payment may be
    corrected again at the instant it was moved to, and an instant that a
    correction leaves is free for the next one. ``old_amount`` is the amount that
    the request replaced and ``stored_datetime`` the payment's instant before the
    batch. A request without a new instant is refused with the reason
    ``datetime_null``. Requests that share no instant with another one are judged
    against the stored payments, the others are replayed.
    """
    rows = flag_known(requests, "payment_method_code", ds.payment_methods, "payment_method_code", "_method", row_id="request_id")
    places = ["original_datetime", "new_datetime"]
    hot = HotKeys(requests, [["customer_id", at] for at in places], scale.hot_rows)
    for at, out in zip(places, ("_here", "_there"), strict=True):
        paid = ds.payments.groupBy("customer_id", "datetime_payment").agg(F.min("amount_payment").alias(out))
        rows = look_up(rows, ["customer_id", at], paid, ["customer_id", "datetime_payment"], hot, "request_id")
    rows = rows.withColumn("_early", X.first_failure([("amount_not_positive", F.col("amount") <= 0), ("method_unknown", ~F.col("_method"))]))
    rows = materialise(rows, "corrections")

    moving = rows.where(
        F.col("_early").isNull() & F.col("customer_id").isNotNull() & F.col("original_datetime").isNotNull() & F.col("new_datetime").isNotNull()
    )
    touched = F.array_distinct(F.array(*[F.xxhash64("customer_id", at) for at in places]))
    linked = sharing(moving.select("request_id", touched.alias("keys")))
    asked = moving.join(linked, "request_id", "left_semi").select(
        "request_id",
        F.struct(
            F.col("customer_id").alias("customer"), F.col("original_datetime").cast("string").alias("here"),
            F.col("new_datetime").cast("string").alias("there"), F.col("amount").cast("string").alias("amount"),
            F.col("_here").cast("string").alias("here_paid"), F.col("_there").cast("string").alias("there_paid"),
        ).alias("ask"),
    )
    said = replay(asked, _Corrections(), scale, within="customer").select(
        "request_id", F.col("reason").alias("_said"), F.col("old_amount").cast("decimal(10,2)").alias("_old"),
        F.col("stored_at").cast("timestamp_ntz").alias("_stored"), F.lit(True).alias("_replayed"),
    )
    moves = F.col("new_datetime") != F.col("original_datetime")
    alone = X.first_failure(
        [
            ("amount_not_positive", F.col("_early") == "amount_not_positive"),
            ("method_unknown", F.col("_early") == "method_unknown"),
            ("payment_not_found", F.col("_here").isNull()),
            ("amount_null", F.col("amount").isNull()),
            ("datetime_null", F.col("new_datetime").isNull()),
            ("duplicate_key", moves & F.col("_there").isNotNull()),
        ]
    )
    both = rows.join(said, "request_id", "left")
    both = both.withColumn("reason", F.when(F.col("_replayed"), F.col("_said")).otherwise(alone)).withColumn("ok", F.col("reason").isNull())

    def found(replayed: str, by_itself: str) -> Column:
        return F.when(F.col("ok"), F.when(F.col("_replayed"), F.col(replayed)).otherwise(F.col(by_itself)))

    return both.select(
        *requests.columns, found("_old", "_here").alias("old_amount"), found("_stored", "original_datetime").alias("stored_datetime"),
        "ok", "reason",
    )


def correction_balances(ds: Dataset, answered: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """Old amount back, new amount off, clamped after every correction in request order."""
    change = (F.col("old_amount") - F.col("amount")).cast("decimal(12,2)")
    steps = answered.where("ok").select("customer_id", "request_id", change.alias("change"))
    return final_balance(steps, "customer_id", ["request_id"], _opening(ds), scale)


def corrected_payments(ds: Dataset, answered: DataFrame) -> DataFrame:
    """The payment table after the accepted corrections: the last one of a payment stands.

    A correction also replaces the note; one without a note clears it.
    """
    row = F.struct(
        F.col("new_datetime").alias("at"), F.col("payment_method_code").alias("method"), "amount", _note(answered).alias("details")
    )
    last = answered.where("ok").groupBy("customer_id", F.col("stored_datetime").alias("datetime_payment")).agg(
        F.max_by(row, "request_id").alias("_new")
    )
    changed = F.col("_new").isNotNull()

    def either(new: str, old: str) -> Column:
        return F.when(changed, F.col(f"_new.{new}")).otherwise(F.col(old)).alias(old)

    return ds.payments.join(last, ["customer_id", "datetime_payment"], "left").select(
        "customer_id", either("at", "datetime_payment"), either("method", "payment_method_code"), either("amount", "amount_payment"),
        either("details", "other_payment_details"),
    )
