"""The demonstration school at 2026-06-15 08:00, against known figures."""

import datetime as dt

import pytest

from tallyslot.plans import reports as R
from tallyslot.plans import views as V
from tallyslot.settings import Clock, StatusSets
from tests.seed import seed_dataset

CLOCK = Clock(dt.datetime(2026, 6, 15, 8, 0, 0))


@pytest.fixture(scope="module")
def ds(spark):
    return seed_dataset(spark)


def rows(df, *columns):
    """Rows as tuples with decimals as floats and dates as text."""

    def plain(v):
        if v is None or isinstance(v, (str, bool, int)):
            return v
        return str(v) if isinstance(v, dt.date) else float(v)

    return [tuple(plain(r[c]) for c in columns) for r in df.collect()]


def keyed(df, *columns):
    return {r[0]: r[1:] for r in rows(df, *columns)}


def test_customer_balance(ds):
    got = keyed(
        V.customer_balance(ds), "customer_id", "total_charged", "total_paid", "calculated_outstanding", "stored_outstanding"
    )
    assert got == {
        1: (135, 135, 0, 0), 2: (75, 75, 0, 0), 3: (70, 70, 0, 0), 4: (70, 50, 20, 0),
        5: (70, 0, 70, 0), 6: (75, 40, 35, 0), 7: (65, 65, 0, 0), 8: (70, 10, 60, 0),
    }


def test_instructor_workload(ds):
    got = keyed(
        V.instructor_workload(ds), "staff_id", "total_lessons", "completed_lessons", "cancelled_lessons", "revenue_generated"
    )
    assert got == {
        1: (5, 3, 0, 270), 2: (4, 2, 0, 150), 3: (3, 2, 1, 140), 4: (2, 1, 0, 70), 5: (0, 0, 0, 0), 6: (0, 0, 0, 0)
    }


def test_vehicle_utilisation(ds):
    got = keyed(V.vehicle_utilisation(ds), "vehicle_id", "lessons_assigned", "lessons_completed", "revenue_from_vehicle")
    assert got == {1: (5, 3, 200), 2: (2, 1, 70), 3: (2, 1, 70), 4: (2, 1, 75), 5: (2, 1, 75), 6: (1, 1, 70)}


def test_monthly_revenue(ds):
    got = set(rows(R.monthly_report(ds), "pay_month", "method", "num_payments", "total_collected"))
    assert got == {
        ("2024-05", "Debit / Credit card", 1, 65), ("2024-06", "Bank transfer / Interac e-Transfer", 1, 70),
        ("2024-06", "Debit / Credit card", 3, 185), ("2024-06", "Cash", 1, 75),
        ("2024-06", "Pre-authorized debit", 1, 40), ("2024-06", "Gift voucher", 1, 10),
    }


def test_customer_lifecycle(ds):
    got = keyed(
        V.customer_lifecycle(ds), "acquisition_month", "new_customers_acquired", "cohort_lifetime_revenue",
        "avg_customer_lifetime_value", "customers_with_lessons", "still_active", "became_inactive",
    )
    assert got == {
        "2024-05-01": (1, 10, 10, 1, 0, 0), "2024-04-01": (1, 40, 40, 1, 0, 0), "2024-03-01": (1, 50, 50, 1, 0, 0),
        "2024-02-01": (2, 145, 72.5, 2, 0, 0), "2024-01-01": (1, 135, 135, 1, 0, 0),
        "2023-11-01": (1, 0, 0, 1, 0, 0), "2023-09-01": (1, 65, 65, 1, 0, 0),
    }


def test_instructor_performance(ds):
    got = keyed(
        V.instructor_performance(ds, CLOCK), "staff_id", "total_lessons_taught", "completed_lessons", "cancelled_lessons",
        "cancellation_rate_percent", "total_lesson_revenue", "avg_lesson_price", "unique_students",
        "days_since_first_lesson", "days_since_last_lesson",
    )
    assert got == {
        1: (5, 3, 0, 0, 350, 70, 3, 756, 0), 2: (4, 3, 0, 0, 300, 75, 2, 740, -3), 3: (3, 2, 1, 33.3, 210, 70, 2, 743, 731),
        4: (2, 1, 0, 0, 140, 70, 1, 737, -1), 5: (0, 0, 0, None, None, None, 0, None, None),
        6: (0, 0, 0, None, None, None, 0, None, None),
    }


def test_lesson_completion_metrics(ds):
    got = rows(
        V.lesson_completion_metrics(ds, CLOCK), "total_lessons", "completed", "cancelled", "rescheduled", "pending",
        "completion_rate_percent", "cancellation_rate_percent", "total_lesson_revenue", "completed_revenue",
        "lost_revenue_cancelled",
    )
    assert got == [(4, 1, 0, 0, 0, 25.0, 0.0, 300, 75, 0)]


def test_financial_health(ds):
    got = rows(
        V.financial_health(ds), "total_active_customers", "total_outstanding", "lifetime_collections",
        "collection_rate_percent", "customers_with_balance", "percent_customers_owing",
    )
    assert got == [(8, 0, 445, 100, 0, 0)]


def test_value_segments_published_codes_match_nobody(ds):
    got = keyed(V.customer_value_segments(ds), "segment", "customer_count", "avg_lifetime_value", "customers_owing")
    assert got == {"High Value": (0, None, 0), "At Risk": (0, None, 0)}


def test_value_segments_working_codes(ds):
    repeated = StatusSets(active=("ACT",), fan_out=True)
    got = keyed(V.customer_value_segments(ds, repeated), "segment", "customer_count", "avg_lifetime_value", "segment_total_value")
    assert got["High Value"] == (2, 210, 420)
    plain = keyed(V.customer_value_segments(ds, StatusSets.working()), "segment", "customer_count", "segment_total_value")
    assert plain["High Value"] == (2, 210)


def test_scheduling_efficiency(ds):
    got = rows(
        V.scheduling_efficiency(ds), "week_starting", "day_of_week", "lesson_hour", "lesson_status_code", "lessons_booked",
        "avg_lesson_price",
    )
    assert len(got) == 14 and all(r[4] == 1 for r in got)
    assert ("2026-06-15", 1, 9, "BOOK", 1, 80) in got
    assert ("2024-06-03", 0, 16, "NOSH", 1, 70) in got
    assert ("2024-05-27", 0, 15, "COMP", 1, 70) in got


def test_schedule_views(ds):
    assert {r.lesson_id for r in V.upcoming_lessons(ds, CLOCK).collect()} == {3, 9, 12}
    assert [r.lesson_id for r in V.today_lessons(ds, CLOCK).collect()] == [3]


def test_active_instructors(ds):
    assert keyed(V.active_instructors(ds, CLOCK), "staff_id", "age") == {1: (46,), 2: (40,), 3: (47,), 4: (35,)}


def test_debtors_in_order(ds):
    got = rows(R.report_debtors(ds), "customer_id", "calculated_outstanding", "action")
    assert got == [
        (5, 70, "Chase for payment"), (8, 60, "Chase for payment"), (6, 35, "Minor balance"), (4, 20, "Minor balance"),
        (1, 0, "Paid up"), (2, 0, "Paid up"), (3, 0, "Paid up"), (7, 0, "Paid up"),
    ]


def test_headline(ds):
    assert [tuple(r) for r in R.report_headline(ds).collect()] == [
        ("David", "CA$270.00", 3, "CA$445.00", 8, "CA$185.00", 2)
    ]


def test_reliability(ds):
    got = rows(R.report_instructor_reliability(ds), "staff_id", "completion_percent", "band")
    assert got == [(1, 60.0, "green"), (2, 50.0, "amber"), (3, 66.7, "green"), (4, 50.0, "amber")]


def test_fleet_order_and_label(ds):
    got = rows(R.report_fleet(ds), "vehicle_id", "vehicle_label")
    assert got[0] == (1, "Honda Civic 2.0 - Manual")


def test_single_row_lookups(ds):
    assert [r.city for r in R.one_address(ds, 3).collect()] == ["Calgary"]
    assert R.one_address(ds, 99).count() == 0
    assert [(r.time, r.notes) for r in R.one_lesson(ds, 10).collect()] == [("16:00", "")]
    assert rows(R.payment_history(ds, 1), "datetime_payment", "payments_of_customer", "total_of_customer") == [
        ("2024-06-10 09:45:00", 2, 135), ("2024-06-03 09:45:00", 2, 135)
    ]


def test_totals_agree(ds):
    """Workload over all staff plus lessons without staff is all lessons; both paid columns agree."""
    taught = sum(r.total_lessons for r in V.instructor_workload(ds).collect())
    assert taught + ds.lessons.where("staff_id IS NULL").count() == ds.lessons.count()
    assert keyed(V.customer_balance(ds), "customer_id", "total_paid") == keyed(
        V.customer_financials(ds), "customer_id", "total_paid"
    )
