"""Rules that are easy to get wrong, each on a few literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyslot.catalog import register_sql
from tallyslot.functions import exprs as X
from tallyslot.plans import accounts as A
from tallyslot.plans import lessons as L
from tallyslot.plans import payments as P
from tallyslot.plans import people as PE
from tallyslot.plans import quality as Q
from tallyslot.plans import reports as R
from tallyslot.plans import views as V
from tallyslot.settings import Clock, Scale, StatusSets
from tallyslot import schema
from tallyslot.sources.dataset import SchemaMismatch, conform, quarantined, read_parquet_dataset, write_table
from tests.seed import seed_dataset

CLOCK = Clock(dt.datetime(2026, 6, 15, 8, 0, 0))


@pytest.fixture(scope="module")
def ds(spark):
    return seed_dataset(spark)


def sql(spark, text):
    return spark.sql(f"SELECT * FROM VALUES {text}")


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).collect()[0].x


def reasons(df):
    return {r.request_id: r.reason for r in df.collect()}


# --- expressions --------------------------------------------------------------
@pytest.mark.parametrize(
    "born, on, age",
    [
        ("2008-02-29", dt.date(2026, 2, 28), 17), ("2008-02-29", dt.date(2026, 3, 1), 18),
        ("2008-02-28", dt.date(2026, 2, 28), 18), ("1980-12-31", dt.date(2001, 1, 1), 20),
    ],
)
def test_age(spark, born, on, age):
    assert one(spark, X.age_years(F.lit(born).cast("date"), on)) == age


def test_names_and_labels(spark):
    null = F.lit(None).cast("string")
    assert one(spark, X.full_name(null, null)) == " "
    assert one(spark, X.full_name(F.lit("A"), null)) == "A "
    assert one(spark, X.joined_parts([F.lit("a"), null, F.lit("")])) == "a, "
    assert one(spark, X.joined_parts([F.lit("a"), null, F.lit("")], keep_empty=False)) == "a"
    assert one(spark, X.staff_label(F.lit(""), F.lit("A"), F.lit("B"))) == "A B"
    assert one(spark, X.staff_label(null, null, F.lit(""))) == "—"
    assert one(spark, X.before_plate(F.lit("Car - Manual - Plate X 1"))) == "Car - Manual"
    assert one(spark, X.or_dash(F.lit(" "))) == " "


def test_numbers(spark):
    assert float(one(spark, X.percent(F.lit(1), F.lit(3), 1))) == 33.3
    assert float(one(spark, X.percent(F.lit(1), F.lit(16), 1))) == 6.3  # 6.25 goes up
    assert one(spark, X.percent(F.lit(1), F.lit(0), 1)) is None
    assert one(spark, X.money_text(F.lit(None).cast("decimal(10,2)"))) == "CA$0.00"
    rows = spark.range(20001).select(F.when(F.col("id") < 101, F.lit("1.00")).otherwise("0.00").cast("decimal(10,2)").alias("v"))
    assert float(rows.agg(X.money_avg("v")).collect()[0][0]) == 0.01
    low = spark.range(20001).select(F.when(F.col("id") < 100, F.lit("1.00")).otherwise("0.00").cast("decimal(10,2)").alias("v"))
    assert float(low.agg(X.money_avg("v")).collect()[0][0]) == 0.0


def test_times(spark):
    assert one(spark, X.lesson_stamp(F.lit("2024-02-29").cast("date"), F.lit(3661))) == dt.datetime(2024, 2, 29, 1, 1, 1)
    assert one(spark, X.clock_text(F.lit(32460))) == "09:01"
    assert one(spark, X.clock_text(F.lit(None).cast("int"))) == ""
    assert one(spark, X.weekday_from_sunday(F.lit("2026-06-14").cast("date"))) == 0
    assert one(spark, X.week_start(F.lit("2026-06-14").cast("date"))) == dt.date(2026, 6, 8)
    moment = dt.datetime(2023, 3, 26, 2, 30, 0, 123456)
    us = one(spark, X.micros(F.lit(moment.isoformat(" ")).cast("timestamp_ntz")))
    assert us == int((moment - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000 + 0.5)
    assert one(spark, X.from_micros(F.lit(us))) == moment


@pytest.mark.parametrize(
    "text, ok",
    [("a@b.c", True), (" a@b.c ", True), ("a@b", False), ("a b@c.d", False), ("@b.c", False), ("", False), (None, False)],
)
def test_email(spark, text, ok):
    assert one(spark, X.valid_email(F.lit(text).cast("string"))) is ok


@pytest.mark.parametrize(
    "text, ok",
    [("", True), (None, True), ("(587) 555-0111", True), ("587 555", False), ("ext. 5875550111", False),
     ("+1234567890123456", False), ("+1.587.555.0111", True)],
)
def test_phone(spark, text, ok):
    assert one(spark, X.valid_phone(F.lit(text).cast("string"))) is ok


# --- views --------------------------------------------------------------------
def test_two_meanings_of_active_instructor(spark, ds):
    staff = ds.staff.withColumn(
        "other_staff_details",
        F.when(F.col("staff_id") == 1, F.lit(None).cast("string")).when(F.col("staff_id") == 2, "Administrator").otherwise(F.col("other_staff_details")),
    )
    changed = ds.replace(staff=staff)
    assert {r.staff_id for r in V.active_instructors(changed, CLOCK).collect()} == {2, 3, 4}
    assert {r.staff_id for r in R.bookable_instructors(changed).collect()} == {1, 3, 4}


def test_missing_instructor_is_one_space(ds):
    lessons = ds.lessons.withColumn("staff_id", F.lit(None).cast("long")).withColumn("vehicle_id", F.lit(None).cast("long"))
    row = R.list_lessons(ds.replace(lessons=lessons)).first()
    assert (row.instructor, row.vehicle) == (" ", "—")


def test_unknown_method_dropped_in_one_report_and_grouped_in_the_other(ds):
    changed = ds.replace(payment_methods=ds.payment_methods.where("payment_method_code <> 'CARD'"))
    assert "Debit / Credit card" not in {r.method for r in V.monthly_revenue(changed).collect()}
    assert sum(r.payment_count for r in V.revenue_analysis(changed).collect() if r.payment_method is None) == 4


def test_working_status_sets_count_customers(ds):
    got = V.customer_lifecycle(ds, StatusSets.working()).agg(F.sum("still_active"), F.sum("became_inactive")).first()
    assert tuple(got) == (6, 0)


def test_future_lessons_count_as_recent(ds):
    later = ds.lessons.withColumn("lesson_date", F.lit("2099-01-01").cast("date"))
    assert V.lesson_completion_metrics(ds.replace(lessons=later), CLOCK).first().total_lessons == 14


def test_empty_inputs_still_give_one_row(ds):
    empty = ds.replace(lessons=ds.lessons.where("false"), payments=ds.payments.where("false"), customers=ds.customers.where("false"))
    row = V.lesson_completion_metrics(empty, CLOCK).first()
    assert (row.total_lessons, row.completion_rate_percent, row.total_lesson_revenue, row.completed_revenue) == (0, None, None, None)
    health = V.financial_health(empty).first()
    assert (health.total_active_customers, health.collection_rate_percent) == (0, None)
    assert R.report_headline(empty).first().top_earner == "—"


def test_users_without_role_kept_or_dropped(spark, ds):
    users = conform(sql(spark, "(1, 'A@x.ca ', 'One', '2024-01-01'), (2, 'b@x.ca', NULL, '2024-01-01') AS t(user_id, email, full_name, created_at)"), "app_users")
    roles = conform(sql(spark, "(1, 'STAFF', '2024-01-01'), (1, 'ADMIN', '2024-01-01') AS t(user_id, role_code, assigned_at)"), "app_user_roles")
    d = ds.replace(app_users=users, app_user_roles=roles)
    assert V.view_user_roles(d).count() == 3 and V.user_roles(d).count() == 2
    assert {r.user_id: r.roles for r in V.app_users(d).collect()} == {1: "ADMIN,STAFF", 2: ""}
    assert {r.user_id: r.roles for r in V.user_role_arrays(d).collect()} == {1: ["ADMIN", "STAFF"], 2: []}
    assert [(r.shown_as, r.roles) for r in R.roles_panel(d).collect()] == [("One", ["ADMIN", "STAFF"]), ("b@x.ca", [])]
    assert {r.email for r in users.collect()} == {"a@x.ca", "b@x.ca"}


def test_search(spark, ds):
    assert [r.address_id for r in R.search_addresses(ds, " STREET 1 ").collect()] == [1, 10]
    assert R.search_addresses(ds, "  ").count() == 0
    asked = sql(spark, "(1, 'calgary'), (2, ' '), (3, 't1'), (4, 'street 10'), (5, 'nowhere'), (6, '9'), (7, 'zz') AS t(search_id, needle)")
    got = {}
    for r in R.address_search(ds, asked).collect():
        got.setdefault(r.search_id, []).append((r["rank"], r.address_id))
    ids = {k: [a for _, a in sorted(v)] for k, v in got.items()}
    assert ids == {1: [1, 2, 3, 4, 5, 6, 7, 8], 3: [1, 10], 4: [10], 6: [9]}


# --- booking and cancellation -------------------------------------------------
def test_booking_reasons_in_order(spark, ds):
    asked = sql(
        spark,
        """(1L, 5L, 99L, 99L, DATE'2020-01-01', 0, -1.00), (2L, 1L, 99L, 99L, DATE'2020-01-01', 0, -1.00), (3L, 1L, 1L, 99L, DATE'2020-01-01', 0, 1.00),
        (4L, 1L, 1L, 1L, DATE'2026-06-15', 28800, 1.00), (5L, 1L, 1L, 2L, DATE'2026-06-15', 32400, 1.00), (6L, 1L, 2L, 1L, DATE'2026-06-15', 32400, -5.00),
        (7L, 1L, 2L, 2L, DATE'2026-06-15', 32400, -5.00), (8L, 2L, 2L, 2L, DATE'2026-06-15', 32400, 20.00), (9L, 1L, 2L, 3L, DATE'2026-06-15', 32400, 9.00),
        (10L, 1L, 2L, 3L, DATE'2024-06-14', 50400, 9.00), (11L, 1L, NULL, NULL, DATE'2026-06-15', 32400, 0.00), (12L, 1L, NULL, NULL, NULL, 1, 0.00)
        AS t(request_id, customer_id, staff_id, vehicle_id, lesson_date, lesson_time_sec, price)""",
    )
    done = L.book(ds, asked, CLOCK)
    assert reasons(done) == {
        1: "customer_not_active", 2: "staff_missing", 3: "vehicle_missing", 4: "in_past", 5: "staff_conflict", 6: "vehicle_conflict",
        7: "price_invalid", 8: None, 9: "staff_conflict", 10: "in_past", 11: None, 12: "date_time_required",
    }
    assert {r.request_id: r.lesson_id for r in done.where("ok").collect()} == {8: 15, 11: 16}
    assert L.booked_lessons(done).count() == 2
    assert {r.customer_id: float(r.balance) for r in L.booking_balances(ds, done).collect()} == {1: 0.0, 2: 20.0}


def test_cancelled_lesson_frees_its_slot(spark, ds):
    asked = sql(spark, "(1L, 1L, 3L, 2L, DATE'2026-06-20', 50400, 5.00) AS t(request_id, customer_id, staff_id, vehicle_id, lesson_date, lesson_time_sec, price)")
    moved = ds.lessons.withColumn("lesson_date", F.when(F.col("lesson_id") == 7, F.lit("2026-06-20").cast("date")).otherwise(F.col("lesson_date")))
    assert reasons(L.book(ds.replace(lessons=moved), asked, CLOCK)) == {1: None}


def test_cancellation(spark, ds):
    asked = sql(spark, "(1L, 99L), (2L, 7L), (3L, 1L), (4L, 3L), (5L, 3L), (6L, 9L), (7L, 12L), (8L, 10L) AS t(request_id, lesson_id)")
    balances = ds.customers.withColumn("amount_outstanding", F.lit("100.00").cast("decimal(10,2)"))
    done = L.cancel(ds.replace(customers=balances), asked, CLOCK)
    assert reasons(done) == {
        1: "lesson_missing", 2: "already_cancelled", 3: "already_completed", 4: None, 5: "already_cancelled", 6: None, 7: None, 8: None,
    }
    # Lesson 3 starts in an hour, 9 in 26 hours, 10 is long past.
    assert {r.lesson_id: float(r.fee) for r in done.where("ok").collect()} == {3: 40.0, 9: 0.0, 12: 0.0, 10: 35.0}
    after = L.cancellation_balances(ds.replace(customers=balances), done)
    assert {r.customer_id: float(r.balance) for r in after.collect()} == {1: 60.0, 4: 30.0, 6: 25.0, 5: 65.0}
    assert L.cancelled_lessons(ds, done).where("lesson_status_code = 'CANC'").count() == 5


def test_exactly_24_hours_is_late(spark, ds):
    asked = sql(spark, "(1L, 9L) AS t(request_id, lesson_id)")
    at = lambda *t: float(L.cancel(ds, asked, Clock(dt.datetime(*t))).first().fee)
    assert at(2026, 6, 15, 10, 0, 0) == 35.0 and at(2026, 6, 15, 9, 59, 59) == 0.0


def test_double_booked_lesson_cannot_be_cancelled(spark, ds):
    clash = ds.lessons.withColumn("lesson_date", F.when(F.col("lesson_id") == 12, F.lit("2026-06-12").cast("date")).otherwise(F.col("lesson_date"))).withColumn(
        "lesson_time_sec", F.when(F.col("lesson_id") == 12, F.lit(39600)).otherwise(F.col("lesson_time_sec"))
    )
    asked = sql(spark, "(1L, 5L), (2L, 12L) AS t(request_id, lesson_id)")
    d = ds.replace(lessons=clash)
    assert reasons(L.cancel(d, asked, CLOCK)) == {1: "staff_conflict", 2: "staff_conflict"}
    assert {(r.conflict, r.lesson_id) for r in L.slot_conflicts(d).collect()} == {("staff", 5), ("staff", 12)}


def test_booking_with_a_status(spark, ds):
    """Booked and updated at once: a cancelled booking holds no slot, an unknown status leaves the lesson booked."""
    asked = sql(
        spark,
        """(1L, 1L, 1L, 1L, DATE'2026-09-01', 32400, 50.00, 'a', 'CANC'), (2L, 1L, 1L, 2L, DATE'2026-09-01', 32400, 50.00, 'b', 'CONF'),
        (3L, 1L, 1L, 3L, DATE'2026-09-01', 32400, 50.00, 'c', 'CANC'), (4L, 1L, 2L, 4L, DATE'2026-09-01', 32400, 50.00, 'd', 'NOPE'),
        (5L, 1L, 3L, 5L, DATE'2026-09-01', 32400, -1.00, 'e', 'CANC'), (6L, 1L, 3L, 5L, DATE'2026-09-01', 32400, 50.00, 'f', NULL)
        AS t(request_id, customer_id, staff_id, vehicle_id, lesson_date, lesson_time_sec, price, other_lesson_details, lesson_status_code)""",
    )
    done = L.book(ds, asked, CLOCK)
    assert reasons(done) == {1: None, 2: None, 3: "staff_conflict", 4: None, 5: "price_invalid", 6: None}
    made = {r.lesson_id: (r.lesson_status_code, r.other_lesson_details) for r in L.booked_lessons(done).collect()}
    assert made == {15: ("CANC", "a"), 16: ("CONF", "b"), 17: ("BOOK", None), 18: ("BOOK", None)}
    assert {tuple(r) for r in L.booking_audit(done).collect()} == {(15, "BOOK", "CANC"), (16, "BOOK", "CONF")}
    assert {r.request_id for r in done.where("status_reason = 'unknown_reference'").collect()} == {4}


def test_update_lessons(spark, ds):
    asked = sql(
        spark,
        """(1L, 3L, 1L, 1L, 1L, DATE'2026-06-15', 32400, 90.00, 'n', CAST(NULL AS STRING)), (2L, 99L, 1L, 1L, 1L, DATE'2026-06-15', 32400, 90.00, 'n', 'COMP'),
        (3L, 9L, 4L, 1L, 3L, DATE'2026-06-15', 32400, 70.00, NULL, 'COMP'), (4L, 12L, 6L, 2L, 5L, DATE'2026-07-01', 32400, 75.00, NULL, 'CONF'),
        (5L, 5L, 2L, 2L, 4L, DATE'2026-07-01', 32400, 75.00, NULL, 'CONF'), (6L, 12L, 6L, 2L, 5L, DATE'2026-07-02', 32400, 75.00, NULL, 'CONF'),
        (7L, 14L, 8L, 3L, 6L, DATE'2024-06-02', 54000, -1.00, NULL, 'COMP'), (8L, 14L, 8L, 3L, 6L, DATE'2024-06-02', 54000, 5.00, NULL, 'COMP') AS t(request_id, lesson_id, customer_id, staff_id, vehicle_id, lesson_date, lesson_time_sec, price, other_lesson_details, lesson_status_code)""",
    )
    done = L.update_lessons(ds, asked)
    assert reasons(done) == {
        1: None, 2: "lesson_missing", 3: "staff_conflict", 4: None, 5: "staff_conflict",
        6: None,  # the second update of a lesson finds what the first has left
        7: "price_invalid", 8: None,
    }
    after = {r.lesson_id: (r.lesson_status_code, float(r.price), r.other_lesson_details) for r in L.updated_lessons(ds, done).collect()}
    assert after[3] == ("BOOK", 90.0, "n") and after[12] == ("CONF", 75.0, None) and len(after) == 14
    assert {r.lesson_id: str(r.lesson_date) for r in L.updated_lessons(ds, done).collect()}[12] == "2026-07-02"
    assert [tuple(r) for r in L.update_audit(done).collect()] == [(12, "BOOK", "CONF")]


def test_lesson_delete_takes_audit_rows(spark, ds):
    audit = sql(spark, "(7, 'BOOK', 'CANC'), (1, 'BOOK', 'COMP') AS t(lesson_id, old_status, new_status)")
    left, log = L.delete_lessons(ds, ds.lessons.where("lesson_id = 7"), audit)
    assert left.count() == 13 and [r.lesson_id for r in log.collect()] == [1]


# --- payments -----------------------------------------------------------------
def test_payment_reasons_and_double_subtraction(spark, ds):
    asked = sql(
        spark,
        """(1L, 99L, TIMESTAMP_NTZ'2026-01-01 00:00:00', 'XXX', 0.00), (2L, 1L, TIMESTAMP_NTZ'2026-01-01 00:00:00', 'XXX', 0.00),
        (3L, 1L, TIMESTAMP_NTZ'2026-01-01 00:00:00', 'CARD', 0.00), (4L, 1L, TIMESTAMP_NTZ'2026-01-01 00:00:00', 'CARD', NULL),
        (5L, 1L, TIMESTAMP_NTZ'2024-06-03 09:45:00', 'CARD', 10.00), (6L, 1L, TIMESTAMP_NTZ'2026-01-01 00:00:00', 'CARD', 10.00),
        (7L, 1L, TIMESTAMP_NTZ'2026-01-01 00:00:00', 'CARD', 11.00), (8L, 2L, TIMESTAMP_NTZ'2026-01-01 00:00:00', 'CARD', 60.00)
        AS t(request_id, customer_id, datetime_payment, payment_method_code, amount)""",
    )
    d = ds.replace(customers=ds.customers.withColumn("amount_outstanding", F.lit("100.00").cast("decimal(10,2)")))
    done = P.record(d, asked)
    assert reasons(done) == {
        1: "customer_missing", 2: "method_unknown", 3: "amount_not_positive", 4: "amount_null", 5: "duplicate_key", 6: None,
        7: "duplicate_key", 8: None,
    }
    assert P.recorded_payments(done).count() == 2
    noted = P.record(d, asked.withColumn("details", F.concat(F.lit("note "), "request_id")))
    assert {r.other_payment_details for r in P.recorded_payments(noted).collect()} == {"note 6", "note 8"}
    assert {r.customer_id: float(r.balance) for r in P.payment_balances(d, done).collect()} == {1: 80.0, 2: 0.0}
    assert {r.customer_id: float(r.balance) for r in P.payment_balances(d, done, False).collect()} == {1: 90.0, 2: 40.0}


def test_corrections(spark, ds):
    asked = sql(
        spark,
        """(1L, 1L, TIMESTAMP_NTZ'2024-06-03 09:45:00', TIMESTAMP_NTZ'2024-06-10 09:45:00', 'CARD', 60.00),
        (2L, 1L, TIMESTAMP_NTZ'2024-06-03 09:45:00', TIMESTAMP_NTZ'2024-06-03 09:45:00', 'CASH', 60.00),
        (3L, 1L, TIMESTAMP_NTZ'2024-06-03 09:45:00', TIMESTAMP_NTZ'2024-06-04 09:45:00', 'CASH', 61.00),
        (4L, 1L, TIMESTAMP_NTZ'2024-06-10 09:45:00', TIMESTAMP_NTZ'2024-06-11 09:45:00', 'CARD', 90.00),
        (5L, 2L, TIMESTAMP_NTZ'2024-06-05 11:00:00', TIMESTAMP_NTZ'2024-06-05 11:00:00', 'CARD', 90.00),
        (6L, 2L, TIMESTAMP_NTZ'2024-06-05 11:45:00', TIMESTAMP_NTZ'2024-06-05 11:45:00', 'NO', 90.00)
        AS t(request_id, customer_id, original_datetime, new_datetime, payment_method_code, amount)""",
    )
    done = P.correct(ds, asked)
    assert reasons(done) == {1: "duplicate_key", 2: None, 3: None, 4: None, 5: "payment_not_found", 6: "method_unknown"}
    # 65 -> 60 owes 5, 60 -> 61 takes one of it, then 70 -> 90 takes 20 and stops at zero.
    assert {r.customer_id: float(r.balance) for r in P.correction_balances(ds, done).collect()} == {1: 0.0}
    table = P.corrected_payments(ds, done)
    assert table.count() == 8
    noted = P.correct(ds, asked.withColumn("details", F.when(F.col("request_id") == 3, "cash after all")))
    notes = {str(r.datetime_payment): r.other_payment_details for r in P.corrected_payments(ds, noted).where("customer_id = 1").collect()}
    assert notes == {"2024-06-04 09:45:00": "cash after all", "2024-06-11 09:45:00": None}
    assert {(str(r.datetime_payment), r.payment_method_code, float(r.amount_payment)) for r in table.where("customer_id = 1").collect()} == {
        ("2024-06-04 09:45:00", "CASH", 61.0), ("2024-06-11 09:45:00", "CARD", 90.0)
    }


# --- people -------------------------------------------------------------------
def test_addresses_found_or_created_once(spark, ds):
    asked = sql(
        spark,
        """(5L, 'Calgary', NULL, '11', 'Street 1', NULL, 'T1', NULL), (9L, 'Calgary', 'Canada', '11', 'Street 1', '', 'T1', NULL),
        (3L, 'Oslo', NULL, '7', NULL, NULL, 'N1', NULL), (4L, 'Oslo', 'Canada', '7', NULL, NULL, 'N1', NULL), (6L, 'Oslo', NULL, NULL, NULL, NULL, 'N1', NULL)
        AS t(request_id, city, country, line_1_number_building, line_2_number_street, line_3_area_locality, zip_postcode, state_province_county)""",
    )
    done = PE.resolve_addresses(ds, asked)
    got = {r.request_id: (r.address_id, r.created, r.reason) for r in done.collect()}
    assert got == {5: (1, False, None), 3: (11, True, None), 4: (11, False, None), 9: (12, True, None), 6: (None, False, "required_missing")}
    made = PE.created_addresses(asked, done)
    assert {(r.address_id, r.city, r.country) for r in made.collect()} == {(11, "Oslo", "Canada"), (12, "Calgary", "Canada")}


def test_customer_delete_and_link_clearing(spark, ds):
    users = conform(sql(spark, "(1, 'a@x.ca', 5, '2024-01-01'), (2, 'b@x.ca', 1, '2024-01-01') AS t(user_id, email, customer_id, created_at)"), "app_users")
    d = ds.replace(lessons=ds.lessons.where("customer_id NOT IN (4, 5)"), app_users=users)
    done = PE.delete_customers(d, sql(spark, "(1L, 4L), (2L, 5L), (3L, 1L), (4L, 77L), (5L, 4L), (6L, 5L) AS t(request_id, customer_id)"))
    got = {r.request_id: (r.ok, r.reason, r.payments_removed, r.users_unlinked) for r in done.collect()}
    assert got == {1: (True, None, 1, 0), 2: (True, None, 0, 1), 3: (False, "has_lessons", 0, 0), 4: (True, None, 0, 0), 5: (True, None, 0, 0), 6: (True, None, 0, 0)}
    after = PE.without_customers(d, done)
    assert after.customers.count() == 6 and after.payments.count() == 7
    assert {r.user_id: r.customer_id for r in after.app_users.collect()} == {1: None, 2: 1}


def test_staff_delete_clears_lessons(ds):
    after = PE.delete_staff(ds, ds.staff.where("staff_id = 1"))
    assert after.staff.count() == 5 and after.lessons.where("staff_id IS NULL").count() == 5


def test_staff_forms_find_or_create_their_address(spark, ds):
    known = ds.addresses.where("address_id = 2").first()
    rows = [
        (1, "add", None, "Ann", known.line_1_number_building, known.city, known.zip_postcode, "ACT"), (2, "add", None, "Bo", " 7 ", "Oslo", "N1", "ACT"),
        (3, "update", 1, "Cy", "7", "Oslo", "N1", "ACT"), (4, "update", 2, "Di", "7", None, "N1", "ACT"), (5, "update", 3, "Ed", None, None, None, "ACT"),
        (6, "add", None, None, "9", "Oslo", "N1", "ACT"), (7, "add", None, "Flo", "8", "Oslo", "N1", "NOPE"),
    ]
    asked = spark.createDataFrame(rows, "request_id long, op string, staff_id long, first_name string, line_1_number_building string, city string, zip_postcode string, customer_status_code string")
    same = {"line_2_number_street": known.line_2_number_street, "line_3_area_locality": known.line_3_area_locality, "state_province_county": known.state_province_county}
    for c, v in same.items():
        asked = asked.withColumn(c, F.when(F.col("request_id") == 1, F.lit(v)).cast("string"))
    asked = asked.withColumn("country", F.when(F.col("request_id") == 1, F.lit(known.country)).cast("string")).withColumn("last_name", F.lit("L"))
    asked = asked.withColumn("date_joined_staff", F.lit("2026-01-01 09:00:00").cast("timestamp_ntz"))
    for c, kind in (("nickname", "string"), ("middle_name", "string"), ("date_of_birth", "date"), ("date_left_staff", "timestamp_ntz"), ("other_staff_details", "string")):
        asked = asked.withColumn(c, F.lit(None).cast(kind))
    done = PE.change_staff(ds, asked)
    assert reasons(done) == {1: None, 2: None, 3: None, 4: "address_incomplete", 5: None, 6: "required_missing", 7: "status_unknown"}
    at = {r.request_id: r.staff_address_id for r in done.collect()}
    assert at[1] == 2 and at[2] == at[3] == 11 and at[4] is None and at[5] is None and at[6] is None and at[7] == 12
    made = PE.form_addresses(ds, asked, done, "staff_address_id").orderBy("address_id").collect()
    assert [(r.address_id, r.line_1_number_building, r.country) for r in made] == [(11, "7", "Canada"), (12, "8", "Canada")]
    assert {r.staff_id: r.staff_address_id for r in PE.changed_staff(ds, done).collect()}[3] is None


def test_a_contested_vehicle_keeps_staff(spark, ds):
    """Taking a name off a lesson is an update: it fails while another lesson holds the vehicle slot, unless that one is cancelled."""
    base = ds.lessons.where("staff_id = 1 AND vehicle_id IS NOT NULL").limit(1)
    for status, bound in (("BOOK", True), ("CANC", False)):
        twin = base.withColumn("lesson_id", F.lit(900).cast("long")).withColumn("staff_id", F.lit(None).cast("long")).withColumn("lesson_status_code", F.lit(status))
        d = ds.replace(lessons=ds.lessons.unionByName(twin))
        assert ({r.staff_id for r in PE.bound_staff(d).collect()} == {1}) is bound
        assert PE.delete_staff(d, d.staff.where("staff_id IN (1, 2)")).staff.count() == (5 if bound else 4)


def test_staff_changes_count_in_request_order(spark, ds):
    """Against a plain loop: several requests per row, refused ones among them, none after a deletion has an effect."""
    asked = [
        (1, "update", 1, " "), (2, "update", 1, "Uma"), (3, "update", 1, "Una"), (4, "update", 1, ""), (5, "update", 2, "Vic"),
        (6, "delete", 2, None), (7, "update", 2, "Val"), (8, "add", None, "New"), (9, "delete", 88, None), (10, "update", 88, "No"),
        (11, "delete", 3, None), (12, "delete", 3, None),
    ]
    columns = {"staff_address_id": "long", "nickname": "string", "middle_name": "string", "other_staff_details": "string",
               "date_of_birth": "date", "date_left_staff": "timestamp_ntz"}
    rows = spark.createDataFrame(asked, "request_id long, op string, staff_id long, first_name string").withColumn("last_name", F.lit("Lee"))
    rows = rows.withColumn("customer_status_code", F.lit("ACT")).withColumn("date_joined_staff", F.lit("2020-01-01").cast("timestamp_ntz"))
    for c, kind in columns.items():
        rows = rows.withColumn(c, F.lit(None).cast(kind))
    done = PE.change_staff(ds, rows)
    table = {r.staff_id: r.first_name for r in ds.staff.collect()}
    want, next_id = {}, max(table) + 1
    for request, op, staff, name in asked:
        blank = op != "delete" and not name.strip()
        want[request] = "required_missing" if blank else None
        if blank:
            continue
        if op == "add":
            table[next_id] = name
        elif op == "delete":
            table.pop(staff, None)
        elif staff in table:
            table[staff] = name
    assert reasons(done) == want
    assert {r.staff_id: r.first_name for r in PE.changed_staff(ds, done).collect()} == table


def test_customer_changes(spark, ds):
    form = "DATE'2000-01-01', DATE'2026-01-01', 'ACT'"
    asked = sql(
        spark,
        f"""(1L, 'add', NULL, ' Ann ', 'Lee', {form}, 'ann@x.ca', '', '7', 'Oslo', 'N1'), (2L, 'add', NULL, 'Bo', 'Lee', {form}, 'ann@x.ca', NULL, NULL, NULL, NULL),
        (3L, 'add', NULL, ' ', 'Lee', {form}, NULL, NULL, NULL, NULL, NULL), (4L, 'add', NULL, 'Cy', 'Lee', {form}, 'bad', NULL, NULL, NULL, NULL),
        (5L, 'add', NULL, 'Di', 'Lee', {form}, NULL, '123', NULL, NULL, NULL), (6L, 'add', NULL, 'Ed', 'Lee', {form}, NULL, NULL, '7', NULL, NULL),
        (7L, 'update', 1L, 'Jim', 'Wright', {form}, NULL, NULL, NULL, NULL, NULL), (8L, 'update', 1L, 'Jon', 'Wright', {form}, NULL, NULL, NULL, NULL, NULL),
        (9L, 'delete', 2L, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL), (10L, 'update', 88L, 'No', 'One', {form}, NULL, NULL, NULL, NULL, NULL)
        AS t(request_id, op, customer_id, first_name, last_name, date_of_birth, date_became_customer, customer_status_code, email_address,
          cell_mobile_phone_number, line_1_number_building, city, zip_postcode)""",
    )
    for c in ["line_2_number_street", "line_3_area_locality", "state_province_county", "country"]:
        asked = asked.withColumn(c, F.lit(None).cast("string"))
    done = PE.change_customers(ds, asked)
    assert reasons(done) == {
        1: None, 2: "email_taken", 3: "required_missing", 4: "email_invalid", 5: "phone_invalid", 6: "address_incomplete", 7: None,
        8: None, 9: "has_lessons", 10: None,
    }
    after = {r.customer_id: r for r in PE.changed_customers(ds, done).collect()}
    assert set(after) == {1, 2, 3, 4, 5, 6, 7, 8, 9}
    made = PE.form_addresses(ds, asked, done).collect()
    assert [(r.address_id, r.line_1_number_building, r.city, r.country) for r in made] == [(11, "7", "Oslo", "Canada")]
    known = {r.address_id for r in ds.addresses.collect()} | {r.address_id for r in made}
    assert {r.customer_address_id for r in after.values()} - {None} <= known
    assert (after[9].first_name, after[9].customer_address_id, float(after[9].amount_outstanding)) == ("Ann", 11, 0.0)
    assert (after[1].first_name, after[1].customer_address_id) == ("Jon", None)


# --- accounts -----------------------------------------------------------------
def _accounts(spark, ds, failed=0, locked=None):
    lock = f"TIMESTAMP_NTZ'{locked}'" if locked else "NULL"
    users = conform(
        sql(spark, f"(1, 'a@x.ca', true, '2024-01-01', {failed}, {lock}), (2, 'b@x.ca', false, '2024-01-01', 0, NULL), (3, 'c@x.ca', true, '2024-01-01', 0, NULL) AS t(user_id, email, is_active, created_at, failed_attempts, locked_until)"),
        "app_users",
    )
    roles = conform(sql(spark, "(1, 'ADMIN', '2024-01-01'), (3, 'ADMIN', '2024-01-01'), (3, 'STAFF', '2024-01-01') AS t(user_id, role_code, assigned_at)"), "app_user_roles")
    return ds.replace(app_users=users, app_user_roles=roles)


def _attempts(spark, minutes, good=()):
    rows = ", ".join(
        f"({i}L, ' A@x.ca', TIMESTAMP_NTZ'2024-01-01 00:00:00' + INTERVAL '{m}' MINUTE, {str(i in good).lower()})" for i, m in enumerate(minutes)
    )
    return sql(spark, f"{rows} AS t(attempt_id, email, attempted_at, password_ok)")


def test_lock_after_five_and_count_outlives_it(spark, ds):
    d = _accounts(spark, ds)
    tries = _attempts(spark, [0, 1, 2, 3, 4, 5, 18, 19, 20, 35, 36], good=(10,))
    got = {r.attempt_id: r.detail for r in A.sign_in(d, tries).collect()}
    assert [got[i] for i in range(11)] == ["bad password"] * 5 + ["locked", "locked", "bad password", "locked", "bad password", "locked"]
    state = A.account_states(d, tries).first()
    assert (state.failed_attempts, str(state.locked_until), state.last_login_at) == (7, "2024-01-01 00:50:00", None)


def test_stored_state_and_closed_accounts(spark, ds):
    d = _accounts(spark, ds, failed=4, locked="2024-01-01 00:05:00")
    got = {r.attempt_id: r.detail for r in A.sign_in(d, _attempts(spark, [4, 5, 6])).collect()}
    assert got == {0: "locked", 1: "bad password", 2: "locked"}
    others = sql(spark, "(1L, 'B@x.ca', TIMESTAMP_NTZ'2024-01-01 00:00:00', true), (2L, 'q@x.ca', TIMESTAMP_NTZ'2024-01-01 00:00:00', true) AS t(attempt_id, email, attempted_at, password_ok)")
    assert {r.attempt_id: (r.detail, r.user_id, r.success) for r in A.sign_in(d, others).collect()} == {1: ("inactive", 2, False), 2: ("no such user", None, False)}


def test_last_administrator_stays(spark, ds):
    d = _accounts(spark, ds)
    asked = sql(spark, "(1L, 9L), (2L, 3L), (3L, 3L), (4L, 1L), (5L, 2L), (6L, 1L) AS t(request_id, user_id)")
    done = A.delete_users(d, asked)
    assert reasons(done) == {1: "user_not_found", 2: None, 3: "user_not_found", 4: "last_admin", 5: None, 6: "last_admin"}
    after = A.without_users(d, done)
    assert {r.user_id for r in after.app_users.collect()} == {1} and after.app_user_roles.count() == 1
    assert {r.email for r in A.removal_audit(done).collect()} == {"b@x.ca", "c@x.ca"}


def test_roles(spark, ds):
    d = _accounts(spark, ds)
    asked = sql(
        spark,
        """(1L, 1L, 'staff', 'assign', TIMESTAMP_NTZ'2024-02-01 00:00:00'), (2L, 9L, 'STAFF', 'assign', TIMESTAMP_NTZ'2024-02-01 00:00:00'),
        (3L, 1L, 'owner', 'assign', TIMESTAMP_NTZ'2024-02-01 00:00:00'), (4L, 3L, 'admin', 'revoke', TIMESTAMP_NTZ'2024-02-01 00:00:00'),
        (5L, 3L, 'ADMIN', 'assign', TIMESTAMP_NTZ'2024-03-01 00:00:00'), (6L, 1L, 'ADMIN', 'assign', TIMESTAMP_NTZ'2024-02-01 00:00:00'),
        (7L, 3L, 'STAFF', 'revoke', TIMESTAMP_NTZ'2024-03-01 00:00:00'), (8L, 9L, 'STAFF', 'revoke', TIMESTAMP_NTZ'2024-03-01 00:00:00')
        AS t(request_id, user_id, role_code, action, requested_at)""",
    )
    done = A.change_roles(d, asked)
    assert reasons(done) == {1: None, 2: "user_missing", 3: "role_missing", 4: None, 5: None, 6: None, 7: None, 8: None}
    held = {(r.user_id, r.role_code): str(r.assigned_at)[:10] for r in A.changed_roles(d, asked).collect()}
    assert held == {(1, "ADMIN"): "2024-01-01", (1, "STAFF"): "2024-02-01", (3, "ADMIN"): "2024-03-01"}


def test_registration(spark, ds):
    d = _accounts(spark, ds)
    asked = sql(
        spark,
        """(1L, ' New@x.ca', 'N', 8, NULL), (2L, 'new@x.ca', 'N', 9, 'admin'), (3L, 'A@X.CA', 'N', 9, 'admin'), (4L, 'n@x.ca', 'N', 7, 'admin'),
        (5L, 'n@x.ca', 'N', 9, 'boss'), (6L, '@x.ca', 'N', 9, 'boss'), (7L, 'n@x.ca', ' ', 9, 'boss'), (8L, 'm@x.ca', 'N', 9, 'report')
        AS t(request_id, email, full_name, password_length, role_code)""",
    )
    done = A.register(d, asked)
    assert reasons(done) == {
        1: None, 2: "already_registered", 3: "already_registered", 4: "password_short", 5: "role_unknown", 6: "email_invalid",
        7: "required_missing", 8: None,
    }
    assert {r.user_id: (r.email, r.role_code) for r in done.where("ok").collect()} == {4: ("new@x.ca", "STAFF"), 5: ("m@x.ca", "REPORT")}


# --- quality and loading ------------------------------------------------------
def test_quality_finds_planted_faults(spark, ds):
    bad = ds.replace(
        lessons=ds.lessons.unionByName(ds.lessons.where("lesson_id = 1")).withColumn("price", F.when(F.col("lesson_id") == 2, F.lit(-1)).otherwise(F.col("price")).cast("decimal(10,2)")),
        customers=ds.customers.withColumn("email_address", F.when(F.col("customer_id") < 3, "same@x.ca")).withColumn("customer_address_id", F.lit(77).cast("long")),
        vehicles=ds.vehicles.withColumn("vehicle_details", F.when(F.col("vehicle_id") > 2, F.rpad("vehicle_details", 101, "x"))),
    )
    dup = {(r.table_name, r.key_columns): (r.repeated_keys, r.rows_involved) for r in Q.duplicate_keys(bad).collect()}
    assert dup["lessons", "lesson_id"] == (1, 2) and dup["customers", "email_address"] == (1, 2) and dup["staff", "staff_id"] == (0, 0)
    lost = {(r.table_name, r.column_name): (r.orphan_values, r.orphan_rows) for r in Q.orphans(bad).collect()}
    assert lost["customers", "customer_address_id"] == (1, 8) and lost["lessons", "staff_id"] == (0, 0)
    assert {(r.table_name, r.column_name): r.rows_broken for r in Q.nulls(bad).collect()}["vehicles", "vehicle_details"] == 2
    assert {r.check_name: r.rows_broken for r in Q.checks(bad).collect()}["price_not_negative"] == 1
    assert {(r.table_name, r.limit_rule): r.rows_broken for r in Q.lengths(bad).collect()}["vehicles", "vehicle_details <= 100"] == 4


def test_loader_checks_schema_and_fills_defaults(spark, ds, tmp_path):
    with pytest.raises(SchemaMismatch, match="lessons lacks required columns: .*price"):
        conform(ds.lessons.drop("price"), "lessons")
    filled = conform(ds.customers.drop("amount_outstanding", "phone_number"), "customers").first()
    assert float(filled.amount_outstanding) == 0.0 and filled.phone_number is None
    for name in ds.names():
        write_table(ds[name], str(tmp_path), name)
    again = read_parquet_dataset(spark, str(tmp_path))
    assert R.report_debtors(again).collect() == R.report_debtors(ds).collect()
    register_sql(again, CLOCK)
    assert spark.sql("SELECT count(*) AS n FROM lessons").first().n == 14
    assert [r.customer_id for r in spark.sql("SELECT customer_id FROM vw_customer_balance WHERE calculated_outstanding > 60").collect()] == [5]
    assert spark.sql("SELECT lesson_id FROM vw_today_lessons").first().lesson_id == 3


def test_a_table_replaces_itself(spark, ds, tmp_path):
    root = str(tmp_path)
    write_table(ds.lessons, root, "lessons")
    first = read_parquet_dataset(spark, root).lessons
    write_table(first.where("lesson_id > 5"), root, "lessons")
    assert read_parquet_dataset(spark, root).lessons.count() == 9 and first.count() == 14
    broken = first.withColumn("price", F.expr("IF(lesson_id = 7, raise_error('stop'), price)"))
    with pytest.raises(Exception, match="stop"):
        write_table(broken, root, "lessons")
    assert read_parquet_dataset(spark, root).lessons.count() == 9
    write_table(read_parquet_dataset(spark, root).lessons.where("lesson_id > 9"), root, "lessons")
    assert read_parquet_dataset(spark, root).lessons.count() == 5


def test_a_plain_folder_is_the_first_version(spark, ds, tmp_path):
    ds.lessons.write.parquet(f"{tmp_path}/lessons")
    write_table(read_parquet_dataset(spark, str(tmp_path)).lessons.limit(3), str(tmp_path), "lessons")
    assert read_parquet_dataset(spark, str(tmp_path)).lessons.count() == 3


def test_jobs_split_hot_keys_with_the_same_result(spark, ds):
    """Two thirds of the rows on one customer, slot or instant: each job gives what it gives without splitting."""
    tight = Scale(hot_rows=4, slice_bits=3)
    many = spark.range(60)
    one = F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 9).cast("long")
    paid = many.select(
        F.col("id").alias("request_id"), one.alias("customer_id"), F.lit("CARD").alias("payment_method_code"),
        F.expr("CAST(5 AS DECIMAL(10,2)) AS amount"), F.expr("TIMESTAMP_NTZ'2026-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id % 2 AS INT)) AS datetime_payment"),
    )
    busy = conform(
        many.select(
            (F.col("id") + 100).alias("lesson_id"), F.lit(1).cast("long").alias("customer_id"), F.lit("BOOK").alias("lesson_status_code"), one.alias("staff_id"),
            F.lit(None).cast("long").alias("vehicle_id"), F.expr("DATE'2026-08-01' AS lesson_date"), F.lit(32400).alias("lesson_time_sec"),
            F.expr("CAST(5 AS DECIMAL(10,2)) AS price"), F.lit(None).cast("string").alias("other_lesson_details"),
        ),
        "lessons",
    )
    d = ds.replace(lessons=busy)
    asked = busy.select(F.col("lesson_id").alias("request_id"), "customer_id", "staff_id", "vehicle_id", "lesson_date", "lesson_time_sec", "price")
    cancels = busy.select(F.col("lesson_id").alias("request_id"), "lesson_id")
    for job in (
        lambda s: P.record(d, paid, s), lambda s: L.slot_conflicts(d, s), lambda s: R.payment_history(d, scale=s), lambda s: L.cancel(d, cancels, CLOCK, s),
        lambda s: PE.delete_customers(d, paid.select("request_id", "customer_id"), s), lambda s: L.book(d, asked, CLOCK, s),
    ):
        plain, split = (sorted(map(repr, job(s).collect())) for s in (Scale(), tight))
        assert plain == split and plain


def test_quality_of_stored_values(spark, ds, tmp_path):
    """Amounts of twelve digits and NULLs where the loader fills defaults are counted on what is stored; such rows can be set aside."""
    root = str(tmp_path)
    for name in ds.names():
        ds[name].write.parquet(f"{root}/{name}")
    amount = F.when(F.col("customer_id") == 1, F.lit("123456789012.00")).otherwise(F.col("amount_payment").cast("string"))
    ds.payments.withColumn("amount_payment", amount).write.mode("overwrite").parquet(f"{root}/payments")
    country = F.when(F.col("address_id") > 3, F.col("country"))
    ds.addresses.withColumn("country", country).write.mode("overwrite").parquet(f"{root}/addresses")
    loaded = read_parquet_dataset(spark, root, lenient=True)
    over = {(r.table_name, r.limit_rule): r.rows_broken for r in Q.lengths(loaded).collect()}
    n = ds.payments.where("customer_id = 1").count()
    assert n > 0 and over["payments", "amount_payment < 10^8"] == n and sum(over.values()) == n
    required = {(t, c.name) for t, cols in schema.TABLES.items() for c in cols if c.required and c.default is not None}
    null = {(r.table_name, r.column_name): r.rows_broken for r in Q.nulls(loaded).collect()}
    assert null.get(("addresses", "country"), 3) == 3 and all(v == 0 for k, v in null.items() if k != ("addresses", "country"))
    assert required  # there are defaulted columns that must not be NULL
    assert loaded.payments.count() == ds.payments.count() - n and loaded.addresses.where("country IS NULL").count() == 0
    aside = quarantined(loaded.stored("payments"), "payments").collect()
    assert len(aside) == n and all(r.reasons == ["amount_payment: not decimal(10,2)"] for r in aside)
    with pytest.raises(Exception):
        read_parquet_dataset(spark, root).payments.agg(F.sum("amount_payment")).collect()


def test_drift_is_reported(ds):
    assert {r.customer_id for r in R.balance_drift(ds).collect()} == {4, 5, 6, 8}
