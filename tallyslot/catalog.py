"""The registry: every named query over a star-schema folder.

``queries()`` maps a name to ``(spark, folder) -> DataFrame``. The plans return
decimals and arrays; ``present`` turns a result into plain column types so that
two engines can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyslot.plans import accounts, lessons, payments, people, quality, reports, views
from tallyslot.settings import Clock, StatusSets
from tallyslot.sources.binding import bind_star_schema
from tallyslot.sources.dataset import Dataset
from tallyslot.streaming import jobs as streams

CLOCK = Clock()
WORKING = StatusSets.working()
# Working codes, but with payments repeated per lesson as in the published report.
REPEATED = StatusSets(active=WORKING.active, fan_out=True)
# Test sign-ins of one user lie hours apart, so a lock must last long to matter.
TEST_LOCK_MINUTES = 720


def present(df: DataFrame) -> DataFrame:
    """Money as double, whole numbers as bigint, arrays as '[a,b]' text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))
        out.append(c.alias(f.name))
    return df.select(*out)


def _remaining_lessons(ds: Dataset) -> DataFrame:
    """Delete the cancelled lessons; show the lessons left with their audit rows."""
    doomed = ds.lessons.where(F.col("lesson_status_code") == "CANC")
    left, audit = lessons.delete_lessons(ds, doomed, lessons.status_audit(ds.lesson_versions))
    rows = audit.groupBy("lesson_id").agg(F.count(F.lit(1)).alias("audit_rows"))
    return left.join(rows, "lesson_id", "left").select(
        "lesson_id", "lesson_status_code", F.coalesce("audit_rows", F.lit(0).cast("long")).alias("audit_rows")
    )


def _remaining_users(ds: Dataset) -> DataFrame:
    after = accounts.without_users(ds, accounts.delete_users(ds, ds.user_delete_requests))
    return views.app_users(after).select("user_id", "email", "roles")


def _onboarding(ds: Dataset) -> DataFrame:
    """Every change request taken as a new customer."""
    adds = ds.customer_changes.withColumn("op", F.lit("add")).withColumn("customer_id", F.lit(None).cast("long"))
    return people.change_customers(ds, adds).select(
        "request_id", "ok", "reason", "customer_id", "address_id", "email_address"
    )


def _left_staff_removed(ds: Dataset) -> DataFrame:
    after = people.delete_staff(ds, ds.staff.where(F.col("date_left_staff").isNotNull()))
    return after.lessons.select("lesson_id", "staff_id")


Plan = Callable[[Dataset], DataFrame]

PLANS: dict[str, Plan] = {
    # scans, lists and look-ups
    "scan_project": reports.scan_project,
    "lookup_reference": reports.lookup_reference,
    "list_addresses": reports.list_addresses,
    "list_staff": reports.list_staff,
    "lookup_address": reports.lookup_address,
    "lookup_lesson": reports.edit_lessons,
    "payment_history": reports.payment_history,
    "address_search": lambda ds: reports.address_search(ds, ds.address_needles),
    "contact_quality": reports.contact_quality,
    "bookable_instructors": reports.bookable_instructors,
    "cancellable_lessons": reports.cancellable_lessons,
    "customer_directory": lambda ds: reports.customer_directory(ds, CLOCK),
    "list_lessons": reports.list_lessons,
    "roles_panel": reports.roles_panel,
    # entity and operational views
    "view_customers": views.view_customers,
    "view_staff": views.view_staff,
    "view_lessons": views.view_lessons,
    "view_customer_payments": views.view_customer_payments,
    "view_user_roles": views.view_user_roles,
    "customer_financials": views.customer_financials,
    "lessons_schedule": views.lessons_schedule,
    "active_instructors": lambda ds: views.active_instructors(ds, CLOCK),
    "lesson_details": views.lesson_details,
    "monthly_revenue": reports.monthly_report,
    "vehicle_utilisation": views.vehicle_utilisation,
    "upcoming_lessons": lambda ds: views.upcoming_lessons(ds, CLOCK),
    "today_lessons": lambda ds: views.today_lessons(ds, CLOCK),
    "customer_full_address": lambda ds: views.customer_full_address(ds, CLOCK),
    "customer_balance": views.customer_balance,
    "instructor_workload": views.instructor_workload,
    "app_users": views.app_users,
    "user_roles": views.user_roles,
    "user_role_arrays": views.user_role_arrays,
    # analytical reports
    "revenue_analysis": views.revenue_analysis,
    "financial_health": views.financial_health,
    "financial_health_fixed": lambda ds: views.financial_health(ds, WORKING),
    "instructor_performance": lambda ds: views.instructor_performance(ds, CLOCK),
    "customer_lifecycle": views.customer_lifecycle,
    "customer_lifecycle_fixed": lambda ds: views.customer_lifecycle(ds, WORKING),
    "customer_value_segments": views.customer_value_segments,
    "customer_value_segments_fixed": lambda ds: views.customer_value_segments(ds, WORKING),
    "customer_value_segments_repeated": lambda ds: views.customer_value_segments(ds, REPEATED),
    "scheduling_efficiency": views.scheduling_efficiency,
    "lesson_completion_metrics": lambda ds: views.lesson_completion_metrics(ds, CLOCK),
    "lesson_completion_metrics_fixed": lambda ds: views.lesson_completion_metrics(ds, CLOCK, WORKING),
    "report_instructor_reliability": reports.report_instructor_reliability,
    "report_debtors": reports.report_debtors,
    "report_fleet": reports.report_fleet,
    "report_headline": reports.report_headline,
    "balance_drift": reports.balance_drift,
    # lesson jobs
    "booking_batch": lambda ds: lessons.book(ds, ds.booking_requests, CLOCK).select(
        "request_id", "ok", "reason", "lesson_id"
    ),
    "booked_lessons": lambda ds: lessons.booked_lessons(lessons.book(ds, ds.booking_requests, CLOCK)),
    "booking_balances": lambda ds: lessons.booking_balances(ds, lessons.book(ds, ds.booking_requests, CLOCK)),
    "cancellation_batch": lambda ds: lessons.cancel(ds, ds.cancel_requests, CLOCK).select(
        "request_id", "lesson_id", "ok", "reason", "fee"
    ),
    "cancellation_balances": lambda ds: lessons.cancellation_balances(ds, lessons.cancel(ds, ds.cancel_requests, CLOCK)),
    "lesson_update_batch": lambda ds: lessons.update_lessons(ds, ds.lesson_changes).select(
        "request_id", "lesson_id", "ok", "reason"
    ),
    "apply_lesson_changes": lambda ds: lessons.updated_lessons(ds, lessons.update_lessons(ds, ds.lesson_changes)),
    "lesson_audit": lambda ds: lessons.status_audit(ds.lesson_versions),
    "lesson_delete": _remaining_lessons,
    "slot_conflicts": lessons.slot_conflicts,
    # payment jobs
    "payment_batch": lambda ds: payments.record(ds, ds.payment_requests).select("request_id", "ok", "reason"),
    "recorded_payments": lambda ds: payments.recorded_payments(payments.record(ds, ds.payment_requests)),
    "payment_balances": lambda ds: payments.payment_balances(ds, payments.record(ds, ds.payment_requests)),
    "payment_balances_once": lambda ds: payments.payment_balances(
        ds, payments.record(ds, ds.payment_requests), double_apply=False
    ),
    "payment_correction": lambda ds: payments.correct(ds, ds.payment_corrections).select(
        "request_id", "ok", "reason", "old_amount"
    ),
    "payment_correction_balances": lambda ds: payments.correction_balances(
        ds, payments.correct(ds, ds.payment_corrections)
    ),
    "apply_payment_corrections": lambda ds: payments.corrected_payments(
        ds, payments.correct(ds, ds.payment_corrections)
    ),
    "running_balance": lambda ds: payments.running_balances(payments.balance_steps(ds)).select(
        "customer_id", "step_at", "kind", "ref", "change", "balance"
    ),
    # people jobs
    "address_resolve": lambda ds: people.resolve_addresses(ds, ds.address_requests),
    "customer_onboarding": _onboarding,
    "customer_change_batch": lambda ds: people.change_customers(ds, ds.customer_changes).select(
        "request_id", "op", "ok", "reason", "customer_id", "address_id"
    ),
    "apply_customer_changes": lambda ds: people.changed_customers(
        ds, people.change_customers(ds, ds.customer_changes)
    ),
    "created_addresses": lambda ds: people.form_addresses(
        ds, ds.customer_changes, people.change_customers(ds, ds.customer_changes)
    ),
    "customer_delete": lambda ds: people.delete_customers(ds, ds.payment_requests.select("request_id", "customer_id")),
    "staff_change_batch": lambda ds: people.change_staff(ds, ds.staff_changes).select(
        "request_id", "op", "ok", "reason", "staff_id"
    ),
    "apply_staff_changes": lambda ds: people.changed_staff(ds, people.change_staff(ds, ds.staff_changes)),
    "staff_delete": _left_staff_removed,
    # account jobs
    "login_lockout": lambda ds: accounts.sign_in(ds, ds.login_attempts, TEST_LOCK_MINUTES),
    "login_lockout_resets": lambda ds: accounts.sign_in(
        ds, ds.login_attempts.withColumn("reset", F.col("attempt_id") % 40 == 7), TEST_LOCK_MINUTES
    ),
    "account_states": lambda ds: accounts.account_states(ds, ds.login_attempts, TEST_LOCK_MINUTES),
    "role_assign_batch": lambda ds: accounts.change_roles(ds, ds.role_requests).select(
        "request_id", "user_id", "role_code", "ok", "reason", "result"
    ),
    "role_holdings": lambda ds: accounts.changed_roles(ds, ds.role_requests),
    "account_onboarding": lambda ds: accounts.register(ds, ds.registration_requests),
    "registered_users": lambda ds: accounts.registered_users(
        accounts.register(ds, ds.registration_requests), CLOCK
    ).select("user_id", "email", "full_name", "is_active", "failed_attempts", "created_at"),
    "registered_roles": lambda ds: accounts.registered_roles(accounts.register(ds, ds.registration_requests), CLOCK),
    "user_delete": lambda ds: accounts.delete_users(ds, ds.user_delete_requests),
    "user_delete_remaining": _remaining_users,
    # data quality
    "dq_duplicate_keys": quality.duplicate_keys,
    "dq_orphans": quality.orphans,
    "dq_nulls": quality.nulls,
    "dq_checks": quality.checks,
    "dq_lengths": quality.lengths,
}

# name: (source table that streams, plan over (stored dataset, streaming dataset))
STREAMS: dict[str, tuple[str, Callable[[Dataset, Dataset], DataFrame]]] = {
    "stream_balance": ("events", lambda ds, live: streams.stream_balance(ds.replace(payments=live.payments))),
    "stream_monthly_revenue": (
        "events",
        lambda ds, live: streams.stream_monthly_revenue(ds.replace(payments=live.payments)),
    ),
    "stream_lesson_audit": ("orders", lambda ds, live: streams.stream_lesson_audit(live.lesson_versions)),
    "stream_login_lockout": (
        "events",
        lambda ds, live: streams.stream_login_lockout(ds, live.login_attempts, TEST_LOCK_MINUTES),
    ),
    "stream_booking": ("orders", lambda ds, live: streams.stream_booking(ds, live.booking_requests, CLOCK)),
}


def run(name: str, spark: SparkSession, root: str) -> DataFrame:
    """Build one registered query over the tables under ``root``."""
    ds = bind_star_schema(spark, root)
    if name in PLANS:
        return present(PLANS[name](ds))
    source, plan = STREAMS[name]
    return present(plan(ds, bind_star_schema(spark, root, streamed=(source,))))


# --- fixed values: the names under which SQL users know the views ------------
SQL_VIEWS: dict[str, str] = {
    "view_customers": "view_customers",
    "view_staff": "view_staff",
    "view_lessons": "view_lessons",
    "view_customer_payments": "view_customer_payments",
    "view_user_roles": "view_user_roles",
    "view_customer_financials": "customer_financials",
    "view_lessons_schedule": "lessons_schedule",
    "vw_active_instructors": "active_instructors",
    "vw_lesson_details": "lesson_details",
    "vw_monthly_revenue": "monthly_revenue",
    "vw_vehicle_utilisation": "vehicle_utilisation",
    "vw_upcoming_lessons": "upcoming_lessons",
    "vw_today_lessons": "today_lessons",
    "vw_customer_full_address": "customer_full_address",
    "vw_customer_balance": "customer_balance",
    "vw_instructor_workload": "instructor_workload",
    "vw_revenue_analysis": "revenue_analysis",
    "vw_financial_health": "financial_health",
    "vw_instructor_performance": "instructor_performance",
    "vw_customer_lifecycle": "customer_lifecycle",
    "vw_customer_value_segments": "customer_value_segments",
    "vw_scheduling_efficiency": "scheduling_efficiency",
    "vw_lesson_completion_metrics": "lesson_completion_metrics",
    "vw_app_users": "app_users",
    "vw_user_roles": "user_roles",
}


def register_sql(ds: Dataset, clock: Clock | None = None) -> None:
    """Make the base tables and all views available to ``spark.sql``.

    Views that depend on the date see ``clock``.
    """
    ds.register_views()
    dated = {
        "active_instructors": views.active_instructors,
        "upcoming_lessons": views.upcoming_lessons,
        "today_lessons": views.today_lessons,
        "customer_full_address": views.customer_full_address,
        "instructor_performance": views.instructor_performance,
        "lesson_completion_metrics": views.lesson_completion_metrics,
    }
    for view, plan in SQL_VIEWS.items():
        df = dated[plan](ds, clock or CLOCK) if plan in dated else PLANS[plan](ds)
        df.createOrReplaceTempView(view)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, root, name=name: run(name, spark, root)) for name in [*PLANS, *STREAMS]}
