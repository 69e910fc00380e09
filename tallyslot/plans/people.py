"""Customer, staff and address jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyslot.functions import exprs as X
from tallyslot.operators.keyed import HotKeys, apply_changes, flag_first, flag_known, look_up
from tallyslot.operators.replay import State, replay, sharing
from tallyslot.operators.references import delete_rows, restricting_keys
from tallyslot.operators.sequence import numbered
from tallyslot.plans.lessons import slot_conflicts
from tallyslot.settings import Scale
from tallyslot.sources.dataset import Dataset, conform
from tallyslot.sources.workdir import materialise

ADDRESS = [
    "line_1_number_building", "line_2_number_street", "line_3_area_locality", "city", "zip_postcode",
    "state_province_county", "country",
]
ADDRESS_REQUIRED = ["line_1_number_building", "city", "zip_postcode"]
DEFAULT_COUNTRY = "Canada"


# --- addresses ---------------------------------------------------------------
def _address_key() -> list[Column]:
    parts = {c: F.col(c).cast("string") for c in ADDRESS}
    parts["country"] = F.coalesce(parts["country"], F.lit(DEFAULT_COUNTRY))
    return [part.alias(c) for c, part in parts.items()]


def _same_address(a: DataFrame, b: DataFrame) -> Column:
    """All seven parts agree, where a missing part agrees with a missing part."""
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in ADDRESS])


def resolve_addresses(ds: Dataset, requests: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """Find or create: ``request_id, address_id, created, reason``.

    Equal requests are resolved once. The lowest matching address id is taken;
    what is left gets new ids in the order of the first request for it.
    """
    complete = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in ADDRESS_REQUIRED])
    keyed = requests.select("request_id", *_address_key())
    groups = keyed.where(complete).groupBy(*ADDRESS).agg(F.min("request_id").alias("_first"))
    stored = ds.addresses.select("address_id", *_address_key()).groupBy(*ADDRESS).agg(
        F.min("address_id").alias("_found")
    )
    matched = groups.join(stored, _same_address(groups, stored), "left").select(
        *[groups[c] for c in ADDRESS], "_first", "_found"
    )
    matched = materialise(matched, "addresses")
    last_id = ds.addresses.agg(F.max("address_id")).scalar()
    fresh = numbered(matched.where(F.col("_found").isNull()).select("_first"), "_first", "_new", last_id, scale.slice_bits)
    resolved = matched.join(fresh, "_first", "left").select(
        *ADDRESS, "_first", F.coalesce("_found", "_new").alias("address_id"), F.col("_found").isNull().alias("_is_new")
    )
    rows = keyed.join(resolved, _same_address(keyed, resolved), "left")
    return rows.select(
        keyed["request_id"],
        "address_id",
        (F.coalesce("_is_new", F.lit(False)) & (F.col("_first") == keyed["request_id"])).alias("created"),
        F.when(F.col("address_id").isNull(), "required_missing").alias("reason"),
    ).withColumn("created", F.coalesce("created", F.lit(False)))


def created_addresses(requests: DataFrame, resolved: DataFrame) -> DataFrame:
    """The rows that ``resolve_addresses`` adds to the address table."""
    made = resolved.where("created").select("request_id", "address_id")
    return conform(requests.join(made, "request_id").select("address_id", *ADDRESS), "addresses")


# --- customers ---------------------------------------------------------------
def _cleaned(requests: DataFrame, fields: tuple[str, ...] = ("first_name", "last_name", "email_address", "cell_mobile_phone_number")) -> DataFrame:
    """Form fields without outer blanks; what is blank is missing."""
    for c in [*fields, *ADDRESS]:
        requests = requests.withColumn(c, X.blank_to_null(F.trim(c)))
    return requests


def _gave_address() -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in ADDRESS if c != "country"])


def _lacks_part() -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in ADDRESS_REQUIRED])


class _CustomerRows:
    """A customer change against the customers that the requests before it left.

    The value of a customer is its e-mail address (empty: none) or NULL where there
    is no such customer; that of an e-mail address is the number of its owners.
    """

    answer = "reason string, missing boolean"

    @staticmethod
    def _keys(ask: dict) -> list[str | None]:
        return [None if ask[c] is None else f"{k}{ask[c]}" for k, c in (("C", "row"), ("E", "email"))]

    def held(self, ask: dict) -> list[tuple[str, str | None]]:
        row, wanted = self._keys(ask)
        own = ask["own_email"]
        found = [(row, own and f"E{own}")] if row else []
        found += [(wanted, str(ask["owners"] or 0))] if wanted else []
        return found + ([(f"E{own}", str(ask["own_owners"] or 0))] if own else [])

    def step(self, state: State, ask: dict) -> tuple:
        row, wanted = self._keys(ask)
        if row is not None and state[row] is None:
            return None, True
        held = state[row] if row is not None else ""
        if ask["op"] != "delete":
            if ask["fault"]:
                return ask["fault"], False
            if wanted and wanted != held and int(state[wanted]) > 0:
                return "email_taken", False
        if held:
            state[held] = str(int(state[held]) - 1)
        if ask["op"] != "delete" and wanted:
            state[wanted] = str(int(state[wanted]) + 1)
        if row is not None:
            state[row] = None if ask["op"] == "delete" else wanted or ""
        return None, False

    def leads_to(self, key: str, value: str | None) -> list[str]:
        return [value] if key.startswith("C") and value else []


def change_customers(ds: Dataset, requests: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """Answer customer adds, updates and deletes in request order: ``request_id, op, ok, reason, customer_id, address_id``
    plus the cleaned form fields and ``missing``.

    The answers are those of handling the requests one by one, any number of them
    per customer: an e-mail address that an accepted request gives up is free for
    the next one. An update or delete of a customer that is not there, or no longer
    there, is accepted, does nothing and is marked ``missing``; its form is still
    checked. Requests that share neither a customer nor an address with another one
    are judged against the stored customers, the others are replayed.
    """
    is_form = F.col("op").isin("add", "update")
    rows = _cleaned(requests)
    required = ["first_name", "last_name", "date_of_birth", "date_became_customer"]
    lacks_required = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])
    form_fault = X.first_failure(
        [
            ("required_missing", lacks_required),
            ("email_invalid", F.col("email_address").isNotNull() & ~X.valid_email("email_address")),
            ("phone_invalid", ~X.valid_phone("cell_mobile_phone_number")),
            ("address_incomplete", _gave_address() & _lacks_part()),
        ]
    )
    rows = rows.withColumn("_form", F.when(is_form, form_fault))
    # The form resolves its address before the row is written, whatever happens to the row.
    asks = rows.where(is_form & F.col("_form").isNull() & _gave_address()).select("request_id", *ADDRESS)
    found = resolve_addresses(ds, asks, scale).select("request_id", "address_id")
    rows = rows.join(found, "request_id", "left")

    rows = flag_known(rows, "customer_status_code", ds.customer_status, "customer_status_code", "_status", row_id="request_id")
    hot = HotKeys(rows, [["customer_id"], ["email_address"]], scale.hot_rows)
    rows = flag_known(rows, "customer_id", ds.lessons, "customer_id", "_has_lessons", None, hot, "request_id")
    owners = ds.customers.where(F.col("email_address").isNotNull()).groupBy(F.col("email_address").alias("_email")).agg(
        F.count(F.lit(1)).alias("_owners")
    )
    stored = ds.customers.groupBy("customer_id").agg(F.min("email_address").alias("_own_email"))
    stored = look_up(stored, ["_own_email"], owners.withColumnRenamed("_owners", "_owners_own"), ["_email"], row_id="customer_id")
    stored = stored.withColumn("_own_email", F.coalesce("_own_email", F.lit("")))
    rows = look_up(rows, ["customer_id"], stored, ["customer_id"], hot, "request_id")
    rows = look_up(rows, ["email_address"], owners.withColumnRenamed("_owners", "_owners_wanted"), ["_email"], hot, "request_id")
    deleting = F.col("op") == "delete"
    rows = rows.withColumn("_refused", F.coalesce(F.when(deleting & F.col("_has_lessons"), "has_lessons"), F.col("_form")))
    rows = rows.withColumn("_late", F.when(~F.col("_status"), "status_unknown"))
    rows = materialise(rows, "customer-checks")

    changing = (F.col("op") != "add") & F.col("customer_id").isNotNull()
    named = F.when(changing, F.col("customer_id"))
    wanted = F.when(is_form, F.col("email_address"))
    own = F.when(changing, F.col("_own_email"))
    open_rows = rows.where(F.col("_refused").isNull())
    hashed = [F.when(named.isNotNull(), F.xxhash64(F.lit("C"), named)), *[F.when(e != "", F.xxhash64(F.lit("E"), e)) for e in (wanted, own)]]
    linked = sharing(open_rows.select("request_id", F.array_distinct(F.array_compact(F.array(*hashed))).alias("keys")))
    asked = open_rows.join(linked, "request_id", "left_semi").select(
        "request_id",
        F.struct(
            "op", named.alias("row"), wanted.alias("email"), own.alias("own_email"), F.col("_owners_wanted").alias("owners"),
            F.col("_owners_own").alias("own_owners"), F.col("_late").alias("fault"),
        ).alias("ask"),
    )
    said = replay(asked, _CustomerRows(), scale).select(
        "request_id", F.col("reason").alias("_said"), F.col("missing").alias("_gone"), F.lit(True).alias("_replayed")
    )
    absent = changing & F.col("_own_email").isNull()
    email_held = (F.col("_owners_wanted") > 0) & ~F.col("email_address").eqNullSafe(F.col("_own_email"))
    alone = F.coalesce(
        F.col("_refused"),
        F.when(is_form & ~absent, F.coalesce(F.col("_late"), F.when(email_held, "email_taken"))),
    )
    replayed = F.coalesce("_replayed", F.lit(False))
    answered = rows.join(said, "request_id", "left").withColumn("reason", F.when(replayed, F.col("_said")).otherwise(alone))
    answered = answered.withColumn("missing", F.when(replayed, F.col("_gone")).otherwise(absent & F.col("reason").isNull()))
    answered = answered.withColumn("ok", F.col("reason").isNull()).select(
        "request_id", "op", "ok", "reason", "customer_id", "address_id", "customer_status_code", "date_became_customer",
        "date_of_birth", "first_name", "last_name", "email_address", "cell_mobile_phone_number", "missing",
    )
    answered = materialise(answered, "customer-answers")
    last_id = ds.customers.agg(F.max("customer_id")).scalar()
    ids = numbered(
        answered.where(F.col("ok") & (F.col("op") == "add")).select("request_id"), "request_id", "_new_id", last_id,
        scale.slice_bits,
    )
    return answered.join(ids, "request_id", "left").withColumn(
        "customer_id", F.when(F.col("op") == "add", F.col("_new_id")).otherwise(F.col("customer_id"))
    ).drop("_new_id")


def changed_customers(ds: Dataset, answered: DataFrame) -> DataFrame:
    """The customer table after the batch: a deletion is final, else the last accepted change of a customer stands."""
    fields = [c for c in answered.columns if c not in ("request_id", "customer_id", "ok", "reason", "missing")]
    rank = F.struct(F.col("op") == "delete", F.col("request_id"))
    last = answered.where("ok AND NOT missing").groupBy("customer_id").agg(F.max_by(F.struct(*fields), rank).alias("_row"))
    changes = last.select("customer_id", "_row.*").withColumnRenamed("address_id", "customer_address_id")
    return conform(apply_changes(ds.customers, changes, "customer_id"), "customers")


def form_addresses(ds: Dataset, requests: DataFrame, answered: DataFrame, column: str = "address_id") -> DataFrame:
    """The address rows that the forms of ``change_customers``, or with ``staff_address_id`` those of ``change_staff``,
    add, also those of refused requests."""
    asked = answered.select("request_id", F.col(column).alias("address_id"))
    new = asked.where(F.col("address_id").isNotNull()).join(ds.addresses, "address_id", "left_anti")
    opener = new.groupBy("address_id").agg(F.min("request_id").alias("request_id"))
    made = _cleaned(requests, ()).join(opener, "request_id").select("address_id", *ADDRESS)
    return conform(made, "addresses")


def delete_customers(ds: Dataset, requests: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """Answer deletions: lessons block a customer; payments go with it and user links are cleared.

    ``request_id, customer_id, ok, reason, payments_removed, users_unlinked``. A
    repeated request finds the customer gone: it is accepted and removes nothing.
    """
    hot = HotKeys(requests, [["customer_id"]], scale.hot_rows)
    rows = flag_known(requests, "customer_id", restricting_keys(ds, "customers"), "_key", "_has_lessons", None, hot, "request_id")
    paid = ds.payments.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_payments"))
    linked = ds.app_users.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("_users")
    )
    ok = ~F.col("_has_lessons")
    rows = flag_first(rows, ["customer_id"], "request_id", "_first", where=ok)

    def count_if_deleted(c: str) -> Column:
        return F.when(ok & F.col("_first"), F.coalesce(c, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))

    for counts in (paid, linked):
        rows = look_up(rows, ["customer_id"], counts, ["customer_id"], hot, "request_id")
    return rows.select(
        "request_id", "customer_id", ok.alias("ok"), F.when(~ok, "has_lessons").alias("reason"),
        count_if_deleted("_payments").alias("payments_removed"), count_if_deleted("_users").alias("users_unlinked"),
    )


def without_customers(ds: Dataset, answered: DataFrame) -> Dataset:
    """The dataset after the accepted deletions."""
    return delete_rows(ds, "customers", "customer_id", answered.where("ok"))


# --- staff -------------------------------------------------------------------
STAFF_FIELDS = [
    "staff_address_id", "customer_status_code", "nickname", "first_name", "middle_name", "last_name", "date_of_birth",
    "date_joined_staff", "date_left_staff", "other_staff_details",
]


def bound_staff(ds: Dataset, scale: Scale = Scale()) -> DataFrame:
    """``staff_id`` of the staff who cannot be deleted.

    Deleting a staff member takes their name off their lessons, and that is an
    update of each lesson like any other: it fails while another lesson that is
    not cancelled holds the same vehicle slot. No deletion changes a vehicle slot,
    so the answer does not hang on the order of deletions.
    """
    contested = slot_conflicts(ds, scale).where("conflict = 'vehicle'").select("lesson_id")
    lessons = ds.lessons.where(F.col("staff_id").isNotNull()).select("lesson_id", "staff_id")
    return lessons.join(contested, "lesson_id", "left_semi").select("staff_id").distinct()


def change_staff(ds: Dataset, requests: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """Answer staff adds, updates and deletes: ``request_id, op, ok, reason, staff_id`` plus the fields.

    Requests share nothing but their row, so each is judged by itself; an update
    or delete of a row that is not there, or no longer there, does nothing. A
    delete is refused while the row rules of a lesson would refuse to let it go.
    Requests that carry the parts of an address find or create it as the customer
    form does, and a form without one leaves the row without an address; requests
    without these columns bring ``staff_address_id`` themselves.
    """
    is_form = F.col("op").isin("add", "update")
    rows = requests
    for c in ["nickname", "first_name", "middle_name", "last_name", "other_staff_details"]:
        rows = rows.withColumn(c, X.blank_to_null(F.trim(c)))
    lacks = F.col("first_name").isNull() | F.col("last_name").isNull() | F.col("date_joined_staff").isNull()
    incomplete = F.lit(False)
    if set(ADDRESS) <= set(requests.columns):
        rows, incomplete = _cleaned(rows, ()), is_form & _gave_address() & _lacks_part()
        asks = rows.where(is_form & ~lacks & _gave_address() & ~_lacks_part()).select("request_id", *ADDRESS)
        found = resolve_addresses(ds, asks, scale).select("request_id", F.col("address_id").alias("staff_address_id"))
        rows = rows.drop("staff_address_id").join(found, "request_id", "left")
    rows = flag_known(rows, "customer_status_code", ds.customer_status, "customer_status_code", "_status", row_id="request_id")
    rows = flag_known(rows, "staff_id", bound_staff(ds, scale), "staff_id", "_bound", row_id="request_id")
    left_early = F.coalesce(F.col("date_left_staff") < F.col("date_joined_staff"), F.lit(False))
    reason = X.first_failure(
        [
            ("vehicle_conflict", (F.col("op") == "delete") & F.col("_bound")),
            ("required_missing", is_form & lacks),
            ("address_incomplete", incomplete),
            ("left_before_joined", is_form & left_early),
            ("status_unknown", is_form & ~F.col("_status")),
        ]
    )
    answered = materialise(
        rows.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull()), "staff-answers"
    )
    last_id = ds.staff.agg(F.max("staff_id")).scalar()
    added = answered.where(F.col("ok") & (F.col("op") == "add")).select("request_id")
    ids = numbered(added, "request_id", "_new_id", last_id, scale.slice_bits)
    return answered.join(ids, "request_id", "left").select(
        "request_id", "op", "ok", "reason", F.coalesce("staff_id", "_new_id").alias("staff_id"), *STAFF_FIELDS
    )


def changed_staff(ds: Dataset, answered: DataFrame) -> DataFrame:
    """The staff table after the batch: a deletion is final, else the last accepted update stands."""
    rank = F.struct(F.col("op") == "delete", F.col("request_id"))
    row = F.struct("op", *STAFF_FIELDS)
    last = answered.where("ok").groupBy("staff_id").agg(F.max_by(row, rank).alias("_row"))
    return conform(apply_changes(ds.staff, last.select("staff_id", "_row.*"), "staff_id"), "staff")


def delete_staff(ds: Dataset, doomed: DataFrame) -> Dataset:
    """The dataset without the doomed staff, save those in ``bound_staff``; their lessons and users stay, unassigned."""
    return delete_rows(ds, "staff", "staff_id", doomed.join(bound_staff(ds), "staff_id", "left_anti"))
