"""Lesson jobs: booking, cancellation, update, deletion, audit and conflict detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyslot import settings as S
from tallyslot.functions import exprs as X
from tallyslot.operators import slots
from tallyslot.operators.balance import charge_only
from tallyslot.operators.keyed import HotKeys, apply_changes, flag_first, flag_known, look_up
from tallyslot.operators.previous import with_previous
from tallyslot.operators.replay import State, replay, sharing
from tallyslot.operators.sequence import numbered
from tallyslot.settings import Clock, Scale
from tallyslot.sources.dataset import Dataset
from tallyslot.sources.workdir import materialise

ACTIVE_CUSTOMER, NEW_LESSON = "ACT", "BOOK"


def _hot(requests: DataFrame, scale: Scale) -> HotKeys:
    """The values that very many requests share, of all keys that requests are looked up by."""
    keys = [["customer_id"], ["staff_id"], ["vehicle_id"], ["staff_id", "_slot"], ["vehicle_id", "_slot"]]
    return HotKeys(requests.withColumn("_slot", slots.slot_key()), keys, scale.hot_rows)


# --- booking -----------------------------------------------------------------
def book(ds: Dataset, requests: DataFrame, clock: Clock, scale: Scale = Scale()) -> DataFrame:
    """Answer booking requests in request order.

    Adds ``ok, reason, lesson_id``. The reason is the first check that fails; a
    bad price is found only after the slot checks and does not take the slot.

    Requests may carry ``lesson_status_code``: the lesson is booked and at once
    given that status, as the booking form does, so one that is booked as cancelled
    holds no slot. ``booked_status`` is the status it ends with; a code that is not
    known leaves the lesson booked and is named in ``status_reason``.
    """
    today = F.lit(clock.date)
    same_day_over = (F.col("lesson_date") == today) & (F.col("lesson_time_sec") <= clock.second_of_day)
    hot = _hot(requests, scale)
    if "lesson_status_code" in requests.columns:
        requests = flag_known(requests, "lesson_status_code", ds.lesson_status, "lesson_status_code", "_code", row_id="request_id")
        strange = F.col("lesson_status_code").isNotNull() & ~F.col("_code")
        requests = requests.withColumn("booked_status", F.when(F.col("_code"), F.col("lesson_status_code")).otherwise(NEW_LESSON))
        requests = requests.withColumn("status_reason", F.when(strange, "unknown_reference")).drop("_code")
    stays = F.col("booked_status") != S.CANCELLED if "booked_status" in requests.columns else F.lit(True)
    checked = flag_known(
        requests, "customer_id", ds.customers, "customer_id", "_customer", F.col("customer_status_code") == ACTIVE_CUSTOMER, hot, "request_id"
    )
    checked = flag_known(checked, "staff_id", ds.staff, "staff_id", "_staff", None, hot, "request_id")
    checked = flag_known(checked, "vehicle_id", ds.vehicles, "vehicle_id", "_vehicle", None, hot, "request_id")
    checked = checked.withColumn(
        "_early",
        X.first_failure(
            [
                ("date_time_required", F.col("lesson_date").isNull() | F.col("lesson_time_sec").isNull()),
                ("customer_not_active", ~F.col("_customer")),
                ("staff_missing", F.col("staff_id").isNotNull() & ~F.col("_staff")),
                ("vehicle_missing", F.col("vehicle_id").isNotNull() & ~F.col("_vehicle")),
                ("in_past", (F.col("lesson_date") < today) | same_day_over),
            ]
        ),
    ).drop("_customer", "_staff", "_vehicle")

    passed = checked.where(F.col("_early").isNull()).withColumn("_slot", slots.slot_key())
    for resource, out in (("staff_id", "_staff_held"), ("vehicle_id", "_vehicle_held")):
        passed = slots.with_holders(passed, ds.lessons, resource, S.CANCELLED, out, hot=hot, row_id="request_id")
    good_price = F.coalesce(F.col("price") >= 0, F.lit(False))
    held = (F.col("_staff_held") > 0) | (F.col("_vehicle_held") > 0)
    # Read several times below, so it is written once instead of recomputed.
    passed = passed.withColumn("_priced", good_price & ~held)
    passed = materialise(passed.withColumn("takes_slot", F.col("_priced") & stays), "booking-open")
    settled = slots.settle(passed, scale)
    reason = X.first_failure(
        [
            ("staff_conflict", (F.col("_staff_held") > 0) | (F.col("slot_conflict") == "staff_conflict")),
            ("vehicle_conflict", (F.col("_vehicle_held") > 0) | (F.col("slot_conflict") == "vehicle_conflict")),
            ("price_invalid", ~F.col("_priced")),
        ]
    )
    base = [c for c in requests.columns]
    answered = settled.select(*base, reason.alias("reason")).unionByName(
        checked.where(F.col("_early").isNotNull()).select(*base, F.col("_early").alias("reason"))
    )
    answered = materialise(answered, "booking-answers")
    last_id = ds.lessons.agg(F.max("lesson_id")).scalar()
    accepted = answered.where(F.col("reason").isNull()).select("request_id")
    ids = numbered(accepted, "request_id", "lesson_id", last_id, scale.slice_bits)
    return answered.join(ids, "request_id", "left").withColumn("ok", F.col("reason").isNull())


def booked_lessons(answered: DataFrame) -> DataFrame:
    """The lesson rows that accepted requests create; a note is kept only where the booking was given a status."""
    status, note = F.lit(NEW_LESSON), F.lit(None).cast("string")
    if "booked_status" in answered.columns:
        status = F.col("booked_status")
        if "other_lesson_details" in answered.columns:
            note = F.when(status != NEW_LESSON, F.col("other_lesson_details"))
    return answered.where("ok").select(
        "lesson_id", "customer_id", status.alias("lesson_status_code"), "staff_id", "vehicle_id",
        "lesson_date", "lesson_time_sec", "price", note.alias("other_lesson_details"),
    )


def booking_audit(answered: DataFrame) -> DataFrame:
    """Audit rows of bookings that were given a status at once."""
    return answered.where(F.col("ok") & (F.col("booked_status") != NEW_LESSON)).select(
        "lesson_id", F.lit(NEW_LESSON).alias("old_status"), F.col("booked_status").alias("new_status")
    )


def booking_balances(ds: Dataset, answered: DataFrame) -> DataFrame:
    """Balances of customers who booked: prices only add, so no clamping is involved."""
    added = answered.where("ok").groupBy("customer_id").agg(F.sum("price").alias("_added"))
    opening = F.col("amount_outstanding")
    return added.join(ds.customers.select("customer_id", "amount_outstanding"), "customer_id").select(
        "customer_id", opening.alias("opening"), (opening + F.col("_added")).cast("decimal(28,2)").alias("balance")
    )


# --- cancellation ------------------------------------------------------------
def cancel(ds: Dataset, requests: DataFrame, clock: Clock, scale: Scale = Scale()) -> DataFrame:
    """Answer cancellation requests: adds ``ok, reason, fee, customer_id, price``.

    Cancelling is an update, so it is also refused while another lesson that is
    not cancelled holds the same staff or vehicle slot. Such a lesson keeps
    blocking whatever else the batch does, so that check needs no ordering.
    """
    owners = ds.customers.select("customer_id").distinct()
    lessons = ds.lessons.join(owners, "customer_id", "left_semi").withColumn("_slot", slots.slot_key())
    lessons = lessons.select(
        "lesson_id", "customer_id", "lesson_status_code", "staff_id", "vehicle_id", "price", "_slot",
        X.lesson_stamp().alias("_starts"), F.lit(True).alias("_found"),
    )
    rows = requests.join(lessons, "lesson_id", "left")
    hot = HotKeys(rows, [["staff_id", "_slot"], ["vehicle_id", "_slot"]], scale.hot_rows)
    for resource, out in (("staff_id", "_staff_held"), ("vehicle_id", "_vehicle_held")):
        rows = slots.with_holders(rows, ds.lessons, resource, S.CANCELLED, out, hot=hot, row_id="request_id")
    status = F.col("lesson_status_code")
    # A lesson that is itself not cancelled is one of the holders.
    rows = rows.withColumn(
        "_fail",
        X.first_failure(
            [
                ("lesson_missing", F.col("_found").isNull()),
                ("already_cancelled", status == S.CANCELLED),
                ("already_completed", status == S.COMPLETED),
                ("staff_conflict", F.col("_staff_held") > 1),
                ("vehicle_conflict", F.col("_vehicle_held") > 1),
            ]
        ),
    )
    rows = flag_first(rows, ["lesson_id"], "request_id", "_first", where=F.col("_fail").isNull())
    reason = F.when(F.col("_fail").isNotNull(), F.col("_fail")).when(~F.col("_first"), "already_cancelled")
    free = F.col("_starts") > X.stamp(clock.as_of) + F.expr(f"INTERVAL '{S.FREE_CANCEL_HOURS}' HOUR")
    share = F.lit(S.LATE_CANCEL_SHARE).cast("decimal(2,1)")
    fee = F.when(free, F.lit(0)).otherwise(F.round(F.col("price") * share, 2)).cast("decimal(10,2)")
    return rows.withColumn("reason", reason).select(
        "request_id", "lesson_id", F.col("reason").isNull().alias("ok"), "reason",
        F.when(F.col("reason").isNull(), fee).alias("fee"), "customer_id", "price",
    )


def cancellation_balances(ds: Dataset, answered: DataFrame) -> DataFrame:
    """Each accepted request takes the price back and adds the fee, never going below zero."""
    # fee <= price, so no step goes up.
    steps = answered.where("ok").select("customer_id", (F.col("fee") - F.col("price")).alias("change"))
    openings = ds.customers.select("customer_id", F.col("amount_outstanding").alias("opening"))
    return charge_only(steps, "customer_id", openings)


def cancelled_lessons(ds: Dataset, answered: DataFrame) -> DataFrame:
    """The lesson table after the batch."""
    gone = answered.where("ok").select("lesson_id", F.lit(True).alias("_gone"))
    status = F.when(F.col("_gone"), S.CANCELLED).otherwise(F.col("lesson_status_code"))
    return ds.lessons.join(gone, "lesson_id", "left").withColumn("lesson_status_code", status).drop("_gone")


# --- update and delete -------------------------------------------------------
class _Moves:
    """A lesson update against the lessons that the requests before it left.

    The value of a lesson is its staff slot, vehicle slot and status; that of a
    slot is the number of lessons that hold it.
    """

    answer = "reason string, old_status string"

    def held(self, ask: dict) -> list[tuple[str, str | int]]:
        own = f"{ask['own_staff'] or ''}|{ask['own_vehicle'] or ''}|{ask['own_status'] or ''}"
        slots = [(ask[c], ask[n]) for c, n in self.COUNTED if ask[c]]
        return [(f"L{ask['lesson']}", own), *slots]

    COUNTED = (("staff", "staff_n"), ("vehicle", "vehicle_n"), ("own_staff", "own_staff_n"), ("own_vehicle", "own_vehicle_n"))

    def step(self, state: State, ask: dict) -> tuple:
        row, staff, vehicle, reason = f"L{ask['lesson']}", ask["staff"], ask["vehicle"], ask["fault"]
        own_staff, own_vehicle, status = state[row].split("|")
        if status in ("", S.CANCELLED):
            own_staff = own_vehicle = ""
        if staff and int(state[staff]) > (own_staff == staff):
            reason = "staff_conflict"
        elif vehicle and int(state[vehicle]) > (own_vehicle == vehicle):
            reason = "vehicle_conflict"
        if reason is None:
            new = ask["status"] or status
            state[row] = f"{staff or ''}|{vehicle or ''}|{new}"
            for slot in (own_staff, own_vehicle):
                if slot:
                    state[slot] = int(state[slot]) - 1
            if new not in ("", S.CANCELLED):
                for slot in (staff, vehicle):
                    if slot:
                        state[slot] = int(state[slot]) + 1
        return reason, status or None

    def leads_to(self, key: str, value: str | None) -> list[str]:
        if not key.startswith("L"):
            return []
        *held, status = value.split("|")
        return [slot for slot in held if slot and status not in ("", S.CANCELLED)]


def _named(kind: str, *columns: str) -> Column:
    """The hash of a lesson, or of a slot of a staff member or vehicle; NULL where there is none."""
    there = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return F.when(there, F.xxhash64(F.lit(kind), *columns))


def update_lessons(ds: Dataset, requests: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """Answer lesson updates in request order: adds ``old_status, ok, reason``.

    The answers are those of handling the requests one by one, any number of them
    per lesson: a slot that an accepted request frees is open to the next one. The
    reason is the first check that fails; ``old_status`` is the status that the
    request found. Requests that share neither a lesson nor a slot with another
    one are judged against the stored tables, the others are replayed.
    """
    own = ds.lessons.select(
        "lesson_id",
        F.col("lesson_status_code").alias("_old_status"),
        F.col("staff_id").alias("_old_staff"),
        F.col("vehicle_id").alias("_old_vehicle"),
        slots.slot_key().alias("_old_slot"),
    )
    rows = requests.join(own, "lesson_id", "left")
    hot = _hot(requests, scale)
    rows = flag_known(rows, "customer_id", ds.customers, "customer_id", "_customer", None, hot, "request_id")
    rows = flag_known(rows, "staff_id", ds.staff, "staff_id", "_staff", None, hot, "request_id")
    rows = flag_known(rows, "vehicle_id", ds.vehicles, "vehicle_id", "_vehicle", None, hot, "request_id")
    rows = flag_known(rows, "lesson_status_code", ds.lesson_status, "lesson_status_code", "_status", row_id="request_id")
    rows = rows.withColumn("_slot", slots.slot_key())
    rows = slots.with_holders(rows, ds.lessons, "staff_id", S.CANCELLED, "_staff_held", hot=hot, row_id="request_id")
    rows = slots.with_holders(rows, ds.lessons, "vehicle_id", S.CANCELLED, "_vehicle_held", hot=hot, row_id="request_id")
    unknown_ref = (
        ~F.col("_customer")
        | (F.col("staff_id").isNotNull() & ~F.col("_staff"))
        | (F.col("vehicle_id").isNotNull() & ~F.col("_vehicle"))
        | (F.col("lesson_status_code").isNotNull() & ~F.col("_status"))
    )
    rows = rows.select(
        *requests.columns, "_old_status", "_old_staff", "_old_vehicle", "_old_slot", "_slot", "_staff_held", "_vehicle_held",
        X.first_failure(
            [
                ("date_time_required", F.col("lesson_date").isNull() | F.col("lesson_time_sec").isNull()),
                ("lesson_missing", F.col("_old_slot").isNull()),
            ]
        ).alias("_early"),
        X.first_failure([("price_invalid", ~F.coalesce(F.col("price") >= 0, F.lit(False))), ("unknown_reference", unknown_ref)]).alias("_late"),
    )
    rows = rows.withColumn("_holds", F.coalesce(F.col("_old_status") != S.CANCELLED, F.lit(False)))
    rows = materialise(rows, "update-checked")

    touched = [_named("L", "lesson_id"), _named("S", "staff_id", "_slot"), _named("V", "vehicle_id", "_slot")]
    touched += [F.when(F.col("_holds"), _named(k, c, "_old_slot")) for k, c in (("S", "_old_staff"), ("V", "_old_vehicle"))]
    linked = sharing(rows.where(F.col("_early").isNull()).select("request_id", F.array_distinct(F.array_compact(F.array(*touched))).alias("keys")))

    open_rows = materialise(rows.join(linked, "request_id", "left_semi"), "update-linked")
    hot = HotKeys(open_rows, [["_old_staff", "_old_slot"], ["_old_vehicle", "_old_slot"]], scale.hot_rows)
    for resource, old, out in (("staff_id", "_old_staff", "_own_staff_n"), ("vehicle_id", "_old_vehicle", "_own_vehicle_n")):
        open_rows = slots.with_holders(open_rows, ds.lessons, resource, S.CANCELLED, out, old, "_old_slot", hot, "request_id")
    plain = {
        "lesson": "lesson_id", "staff_n": "_staff_held", "vehicle_n": "_vehicle_held", "own_staff_n": "_own_staff_n", "own_vehicle_n": "_own_vehicle_n",
        "own_status": "_old_status", "status": "lesson_status_code", "fault": "_late",
    }
    named = {"staff": ("S", "staff_id", "_slot"), "vehicle": ("V", "vehicle_id", "_slot"), "own_staff": ("S", "_old_staff", "_old_slot"), "own_vehicle": ("V", "_old_vehicle", "_old_slot")}
    named = [F.concat(F.lit(kind), F.col(of).cast("string"), F.lit("@"), F.col(slot).cast("string")).alias(n) for n, (kind, of, slot) in named.items()]
    asked = open_rows.select("request_id", F.struct(*named, *[F.col(c).alias(n) for n, c in plain.items()]).alias("ask"))
    replayed = replay(asked, _Moves(), scale).select(
        "request_id", F.col("reason").alias("_said"), F.col("old_status").alias("_found"), F.lit(True).alias("_replayed")
    )

    def taken(count: str, wanted: str, own: str) -> Column:
        mine = F.when(F.col("_holds") & (F.col("_slot") == F.col("_old_slot")) & (F.col(wanted) == F.col(own)), 1).otherwise(0)
        return F.col(count) - mine > 0

    alone = F.coalesce(
        F.col("_early"),
        X.first_failure(
            [
                ("staff_conflict", taken("_staff_held", "staff_id", "_old_staff")),
                ("vehicle_conflict", taken("_vehicle_held", "vehicle_id", "_old_vehicle")),
            ]
        ),
        F.col("_late"),
    )
    both = rows.join(replayed, "request_id", "left")
    reason = F.when(F.col("_replayed"), F.col("_said")).otherwise(alone)
    status = F.when(F.col("_replayed"), F.col("_found")).otherwise(F.col("_old_status"))
    return both.select(*requests.columns, status.alias("old_status"), reason.isNull().alias("ok"), reason.alias("reason"))


def updated_lessons(ds: Dataset, answered: DataFrame) -> DataFrame:
    """The lesson table after the accepted updates: the last one of a lesson stands, and a NULL status keeps the one it found."""
    fields = [c for c in answered.columns if c not in ("request_id", "lesson_id", "old_status", "ok", "reason")]
    done = answered.where("ok").withColumn("lesson_status_code", F.coalesce("lesson_status_code", "old_status"))
    last = done.groupBy("lesson_id").agg(F.max_by(F.struct(*fields), "request_id").alias("_row"))
    return apply_changes(ds.lessons, last.select("lesson_id", "_row.*", F.lit("update").alias("op")), "lesson_id")


def update_audit(answered: DataFrame) -> DataFrame:
    """Audit rows of accepted updates: only where the status really changes."""
    return answered.where(F.col("ok") & (F.col("lesson_status_code") != F.col("old_status"))).select(
        "lesson_id", "old_status", F.col("lesson_status_code").alias("new_status")
    )


def status_audit(versions: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """Audit log of a version history: one row per step whose status differs from the step before."""
    rows = with_previous(versions, "lesson_id", "version", "lesson_status_code", "old_status", scale)
    return rows.where(F.col("lesson_status_code") != F.col("old_status")).select(
        "lesson_id", "version", "old_status", F.col("lesson_status_code").alias("new_status"),
        F.lit("system").alias("changed_by"),
    )


def delete_lessons(ds: Dataset, doomed: DataFrame, audit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(lessons, audit)`` without the doomed lessons; balances stay as they are."""
    ids = doomed.select("lesson_id").distinct()
    return ds.lessons.join(ids, "lesson_id", "left_anti"), audit.join(ids, "lesson_id", "left_anti")


# --- conflicts ---------------------------------------------------------------
def slot_conflicts(ds: Dataset, scale: Scale = Scale()) -> DataFrame:
    """Lessons whose staff or vehicle slot is also held by another, not cancelled lesson.

    Slots are counted first and matched back; a slot that very many lessons hold
    is split.
    """
    lessons = ds.lessons.withColumn("_slot", slots.slot_key())
    hot = HotKeys(lessons, [["staff_id", "_slot"], ["vehicle_id", "_slot"]], scale.hot_rows)
    status_holds = F.when(F.col("lesson_status_code") != S.CANCELLED, 1).otherwise(0)
    parts = []
    for resource, label in (("staff_id", "staff"), ("vehicle_id", "vehicle")):
        contested = slots.slot_counts(ds.lessons, resource, S.CANCELLED)
        found = look_up(lessons.where(F.col(resource).isNotNull()), [resource, "_slot"], contested, [resource, "_slot"], hot, "lesson_id")
        others = F.col("_holders") - status_holds
        parts.append(
            found.withColumn("other_lessons", others)
            .where(F.col("other_lessons") > 0)
            .select(
                F.lit(label).alias("conflict"), "lesson_id", F.col(resource).alias("resource_id"), "lesson_date",
                "lesson_time_sec", "lesson_status_code", "other_lessons",
            )
        )
    return parts[0].unionByName(parts[1])
