"""The read side: one function per view, ``Dataset`` in and ``DataFrame`` out.

Facts are aggregated before they meet a dimension. No join carries a hint:
Spark broadcasts a side only when its measured size is under the session's
limit, and adaptive execution splits a skewed shuffle join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyslot import settings as S
from tallyslot.functions import exprs as X
from tallyslot.operators.sequence import exact_percentiles
from tallyslot.settings import Clock, StatusSets
from tallyslot.sources.dataset import Dataset


def _names(people: DataFrame, key: str, prefix: str, *extra: str) -> DataFrame:
    """Key and prefixed name columns of a person table."""
    return people.select(
        key,
        F.col("first_name").alias(f"{prefix}_first_name"),
        F.col("last_name").alias(f"{prefix}_last_name"),
        *extra,
    )


def _paid(ds: Dataset) -> DataFrame:
    return ds.payments.groupBy("customer_id").agg(
        F.sum("amount_payment").alias("total_paid"), F.max("datetime_payment").alias("last_payment")
    )


# --- entity views ------------------------------------------------------------
def view_customers(ds: Dataset) -> DataFrame:
    c = ds.customers.withColumnRenamed("customer_address_id", "address_id")
    joined = c.join(ds.addresses, "address_id", "left").join(ds.customer_status, "customer_status_code", "left")
    # An address id without an address row shows as NULL, so take the id from the address side.
    found = F.when(F.col("line_1_number_building").isNotNull(), F.col("address_id"))
    own = [
        "customer_id", "first_name", "last_name", "date_became_customer", "date_of_birth", "email_address",
        "phone_number", "cell_mobile_phone_number", "amount_outstanding", "other_customer_details",
        "customer_status_code", "customer_status_description",
    ]
    place = [
        "line_1_number_building", "line_2_number_street", "line_3_area_locality", "city", "zip_postcode",
        "state_province_county", "country", "other_address_details",
    ]
    return joined.select(*own, found.alias("address_id"), *place)


def view_staff(ds: Dataset) -> DataFrame:
    s = ds.staff.withColumnRenamed("staff_address_id", "address_id")
    joined = s.join(ds.addresses, "address_id", "left").join(ds.customer_status, "customer_status_code", "left")
    found = F.when(F.col("line_1_number_building").isNotNull(), F.col("address_id"))
    return joined.select(
        "staff_id", "nickname", "first_name", "middle_name", "last_name", "date_of_birth", "date_joined_staff",
        "date_left_staff", "other_staff_details", "customer_status_code", "customer_status_description",
        found.alias("address_id"), "line_1_number_building", "line_2_number_street", "city", "zip_postcode",
        "state_province_county", "country",
    )


def _lessons_with_names(ds: Dataset, *customer_extra: str) -> DataFrame:
    return (
        ds.lessons.join(ds.lesson_status, "lesson_status_code", "left")
        .join(_names(ds.customers, "customer_id", "customer", *customer_extra), "customer_id", "left")
        .join(_names(ds.staff, "staff_id", "staff"), "staff_id", "left")
        .join(ds.vehicles, "vehicle_id", "left")
        .withColumn("lesson_datetime", X.lesson_stamp())
    )


def view_lessons(ds: Dataset) -> DataFrame:
    return _lessons_with_names(ds).select(
        "lesson_id", "customer_id", "customer_first_name", "customer_last_name", "staff_id", "staff_first_name",
        "staff_last_name", "vehicle_id", "vehicle_details", "lesson_date", "lesson_time_sec", "lesson_datetime",
        "price", "other_lesson_details", "lesson_status_code", "lesson_status_description",
    )


def lessons_schedule(ds: Dataset) -> DataFrame:
    return _lessons_with_names(ds, "email_address").select(
        "lesson_id", "lesson_datetime", "lesson_date", "lesson_time_sec", "lesson_status_description", "price",
        "customer_id", "customer_first_name", "customer_last_name", F.col("email_address").alias("customer_email"),
        "staff_id", "staff_first_name", "staff_last_name", "vehicle_details",
    )


def view_customer_payments(ds: Dataset) -> DataFrame:
    names = ds.customers.select("customer_id", "first_name", "last_name")
    return (
        ds.payments.join(ds.payment_methods, "payment_method_code", "left")
        .join(names, "customer_id", "left")
        .select(
            "customer_id", "first_name", "last_name", "datetime_payment", "payment_method_code",
            "payment_method_description", "amount_payment", "other_payment_details",
        )
    )


def customer_financials(ds: Dataset) -> DataFrame:
    return ds.customers.join(_paid(ds), "customer_id", "left").select(
        "customer_id", "first_name", "last_name", "amount_outstanding",
        X.zero_if_null("total_paid").alias("total_paid"), "last_payment",
    )


# --- accounts ----------------------------------------------------------------
def view_user_roles(ds: Dataset) -> DataFrame:
    """Users without a role are kept."""
    return (
        ds.app_users.join(ds.app_user_roles, "user_id", "left")
        .join(ds.app_roles, "role_code", "left")
        .join(_names(ds.staff, "staff_id", "staff"), "staff_id", "left")
        .join(_names(ds.customers, "customer_id", "customer"), "customer_id", "left")
        .select(
            "user_id", "email", "full_name", "is_active", "staff_id", "staff_first_name", "staff_last_name",
            "customer_id", "customer_first_name", "customer_last_name", "role_code", "role_name", "assigned_at",
        )
    )


def user_roles(ds: Dataset) -> DataFrame:
    """Users without a role are dropped."""
    return (
        ds.app_user_roles.join(ds.app_users, "user_id")
        .join(ds.app_roles, "role_code")
        .select("user_id", "email", "role_code", "role_name", "assigned_at")
    )


def role_lists(roles: DataFrame) -> DataFrame:
    """``user_id, roles``: sorted codes. A user holds a code once, so a list is as long as the role set."""
    return roles.groupBy("user_id").agg(F.sort_array(F.collect_set("role_code")).alias("roles"))


def app_users(ds: Dataset) -> DataFrame:
    text = F.coalesce(F.array_join("roles", ","), F.lit(""))
    return ds.app_users.join(role_lists(ds.app_user_roles), "user_id", "left").select(
        "user_id", "email", "full_name", "is_active", "staff_id", "customer_id", "created_at", "last_login_at",
        text.alias("roles"),
    )


def user_role_arrays(ds: Dataset) -> DataFrame:
    """What a successful sign-in returns: the account and its roles, an empty array if none."""
    none = F.array().cast("array<string>")
    return ds.app_users.join(role_lists(ds.app_user_roles), "user_id", "left").select(
        "user_id", "email", "full_name", F.coalesce("roles", none).alias("roles")
    )


# --- operational views -------------------------------------------------------
def active_instructors(ds: Dataset, clock: Clock) -> DataFrame:
    """Not left and not an administrator; case-sensitive, and a NULL note drops the row."""
    notes = F.col("other_staff_details")
    return ds.staff.where(F.col("date_left_staff").isNull() & ~notes.like("%administrator%")).select(
        "staff_id",
        X.full_name("first_name", "last_name").alias("instructor_name"),
        "nickname",
        X.age_years("date_of_birth", clock.date).alias("age"),
        "date_joined_staff",
        "other_staff_details",
    )


def lesson_details(ds: Dataset) -> DataFrame:
    """Unknown customer or status drops the lesson; a missing instructor shows as one space."""
    status = ds.lesson_status.withColumnRenamed("lesson_status_description", "status")
    return (
        ds.lessons.join(_names(ds.customers, "customer_id", "customer"), "customer_id")
        .join(status, "lesson_status_code")
        .join(_names(ds.staff, "staff_id", "staff"), "staff_id", "left")
        .join(ds.vehicles, "vehicle_id", "left")
        .select(
            "lesson_id", "lesson_date", "lesson_time_sec", "price", "status",
            X.full_name("customer_first_name", "customer_last_name").alias("customer_name"),
            X.full_name("staff_first_name", "staff_last_name").alias("instructor_name"),
            "vehicle_details", "other_lesson_details",
        )
    )


def upcoming_lessons(ds: Dataset, clock: Clock) -> DataFrame:
    keep = (F.col("lesson_date") >= F.lit(clock.date)) & ~F.col("status").isin(*S.NOT_UPCOMING)
    return lesson_details(ds).where(keep).orderBy("lesson_date", "lesson_time_sec", "lesson_id")


def today_lessons(ds: Dataset, clock: Clock) -> DataFrame:
    return lesson_details(ds).where(F.col("lesson_date") == F.lit(clock.date)).orderBy("lesson_time_sec", "lesson_id")


def customer_full_address(ds: Dataset, clock: Clock, *extra: Column) -> DataFrame:
    """Name, age, address line and status; ``extra`` adds columns of the customer row."""
    c = ds.customers.withColumnRenamed("customer_address_id", "address_id")
    parts = ["line_1_number_building", "line_2_number_street", "line_3_area_locality", "city", "zip_postcode"]
    return (
        c.join(ds.addresses.select("address_id", *parts), "address_id", "left")
        .join(ds.customer_status, "customer_status_code")
        .select(
            "customer_id",
            X.full_name("first_name", "last_name").alias("customer_name"),
            X.age_years("date_of_birth", clock.date).alias("age"),
            "email_address",
            "cell_mobile_phone_number",
            X.joined_parts(parts).alias("full_address"),
            F.col("customer_status_description").alias("status"),
            *extra,
        )
    )


# --- money and workload ------------------------------------------------------
def monthly_revenue(ds: Dataset) -> DataFrame:
    """Payments with an unknown method are left out."""
    # Codes are grouped before the look-up, so the join sees months x methods rows.
    by_code = ds.payments.groupBy(X.month_text("datetime_payment").alias("pay_month"), "payment_method_code").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("amount_payment").alias("_total")
    )
    return (
        by_code.join(ds.payment_methods, "payment_method_code")
        .groupBy("pay_month", F.col("payment_method_description").alias("method"))
        .agg(F.sum("_n").alias("num_payments"), F.sum("_total").alias("total_collected"))
    )


def vehicle_utilisation(ds: Dataset) -> DataFrame:
    done = F.col("lesson_status_code") == S.COMPLETED
    per_vehicle = (
        ds.lessons.where(F.col("vehicle_id").isNotNull())
        .groupBy("vehicle_id")
        .agg(
            F.count(F.lit(1)).alias("lessons_assigned"),
            F.count_if(done).alias("lessons_completed"),
            F.sum(F.when(done, F.col("price"))).alias("revenue_from_vehicle"),
        )
    )
    zero = F.lit(0).cast("long")
    return ds.vehicles.join(per_vehicle, "vehicle_id", "left").select(
        "vehicle_id",
        "vehicle_details",
        F.coalesce("lessons_assigned", zero).alias("lessons_assigned"),
        F.coalesce("lessons_completed", zero).alias("lessons_completed"),
        X.zero_if_null("revenue_from_vehicle").alias("revenue_from_vehicle"),
    )


def customer_balance(ds: Dataset) -> DataFrame:
    """Charged, paid and calculated balance next to the stored one."""
    charged = (
        ds.lessons.where(F.col("lesson_status_code").isin(*S.BILLABLE))
        .groupBy("customer_id")
        .agg(F.sum("price").alias("charged"))
    )
    charges, paid = X.zero_if_null("charged"), X.zero_if_null("total_paid")
    return (
        ds.customers.join(charged, "customer_id", "left")
        .join(_paid(ds).select("customer_id", "total_paid"), "customer_id", "left")
        .select(
            "customer_id",
            X.full_name("first_name", "last_name").alias("customer_name"),
            charges.alias("total_charged"),
            paid.alias("total_paid"),
            (charges - paid).alias("calculated_outstanding"),
            F.col("amount_outstanding").alias("stored_outstanding"),
        )
    )


def instructor_workload(ds: Dataset) -> DataFrame:
    status = F.col("lesson_status_code")
    per_staff = (
        ds.lessons.where(F.col("staff_id").isNotNull())
        .groupBy("staff_id")
        .agg(
            F.count(F.lit(1)).alias("total_lessons"),
            F.count_if(status == S.COMPLETED).alias("completed_lessons"),
            F.count_if(status == S.CANCELLED).alias("cancelled_lessons"),
            F.sum(F.when(status.isin(*S.BILLABLE), F.col("price"))).alias("revenue_generated"),
        )
    )
    zero = F.lit(0).cast("long")
    return ds.staff.join(per_staff, "staff_id", "left").select(
        "staff_id",
        X.full_name("first_name", "last_name").alias("instructor_name"),
        *[F.coalesce(c, zero).alias(c) for c in ("total_lessons", "completed_lessons", "cancelled_lessons")],
        X.zero_if_null("revenue_generated").alias("revenue_generated"),
    )


# --- analytical reports ------------------------------------------------------
def revenue_analysis(ds: Dataset) -> DataFrame:
    """Payments with an unknown method form the NULL group."""
    return (
        ds.payments.join(ds.payment_methods, "payment_method_code", "left")
        .groupBy(
            X.month_start("datetime_payment").alias("month"),
            F.col("payment_method_description").alias("payment_method"),
        )
        .agg(
            F.count_distinct("customer_id").alias("unique_payers"),
            F.count(F.lit(1)).alias("payment_count"),
            F.sum("amount_payment").alias("total_revenue"),
            X.money_avg("amount_payment", 6).alias("avg_payment_amount"),
            F.min("amount_payment").alias("min_payment_amount"),
            F.max("amount_payment").alias("max_payment_amount"),
        )
        .orderBy(F.desc("month"), F.desc_nulls_first("total_revenue"), F.asc_nulls_last("payment_method"))
    )


def financial_health(ds: Dataset, sets: StatusSets = StatusSets()) -> DataFrame:
    """One row of totals and rates; customers in an excluded status do not count."""
    collected = ds.payments.agg(F.sum("amount_payment")).scalar()
    owing = F.col("amount_outstanding") > 0
    totals = ds.customers.where(~F.col("customer_status_code").isin(*sets.excluded)).agg(
        F.count(F.lit(1)).alias("total_active_customers"),
        X.zero_if_null(F.sum("amount_outstanding")).alias("total_outstanding"),
        F.count_if(owing).alias("customers_with_balance"),
    )
    totals = totals.withColumn("lifetime_collections", X.zero_if_null(collected))
    money = F.col("lifetime_collections")
    return totals.select(
        "total_active_customers",
        F.col("total_outstanding").cast("decimal(20,2)").alias("total_outstanding"),
        money.cast("decimal(20,2)").alias("lifetime_collections"),
        X.percent(money, F.col("total_outstanding") + money, 2).alias("collection_rate_percent"),
        "customers_with_balance",
        X.percent(F.col("customers_with_balance"), F.col("total_active_customers"), 2).alias("percent_customers_owing"),
    )


def instructor_performance(ds: Dataset, clock: Clock) -> DataFrame:
    """Completed means done or confirmed; revenue sums every lesson, cancelled ones too."""
    status, today = F.col("lesson_status_code"), F.lit(clock.date)
    # lesson_id is a key, so counting rows equals counting distinct lessons.
    per_staff = (
        ds.lessons.where(F.col("staff_id").isNotNull())
        .groupBy("staff_id")
        .agg(
            F.count(F.lit(1)).alias("total_lessons_taught"),
            F.count_if(status.isin(*S.DONE_OR_CONFIRMED)).alias("completed_lessons"),
            F.count_if(status == S.CANCELLED).alias("cancelled_lessons"),
            F.sum("price").alias("total_lesson_revenue"),
            X.money_avg("price").alias("avg_lesson_price"),
            F.count_distinct("customer_id").alias("unique_students"),
            F.min("lesson_date").alias("_first"),
            F.max("lesson_date").alias("_last"),
        )
    )
    zero = F.lit(0).cast("long")
    counts = ["total_lessons_taught", "completed_lessons", "cancelled_lessons"]
    return (
        ds.staff.join(per_staff, "staff_id", "left")
        .select(
            "staff_id",
            X.full_name("first_name", "last_name").alias("instructor_name"),
            *[F.coalesce(c, zero).alias(c) for c in counts],
            X.percent(F.col("cancelled_lessons"), F.col("total_lessons_taught"), 1).alias("cancellation_rate_percent"),
            "total_lesson_revenue",
            "avg_lesson_price",
            F.coalesce("unique_students", zero).alias("unique_students"),
            F.datediff(today, "_first").alias("days_since_first_lesson"),
            F.datediff(today, "_last").alias("days_since_last_lesson"),
            "date_joined_staff",
            F.when(F.col("date_left_staff").isNull(), "Active").otherwise("Inactive").alias("employment_status"),
        )
        .orderBy(F.desc_nulls_last("total_lesson_revenue"), "staff_id")
    )


def customer_lifecycle(ds: Dataset, sets: StatusSets = StatusSets()) -> DataFrame:
    """Cohorts by the month a customer joined."""
    # Both facts shrink to one row per customer and share the customers' partitioning.
    taught = ds.lessons.groupBy("customer_id").agg(F.lit(True).alias("_has_lesson"))
    spend = X.zero_if_null("total_paid")
    status = F.col("customer_status_code")
    return (
        ds.customers.join(_paid(ds).select("customer_id", "total_paid"), "customer_id", "left")
        .join(taught, "customer_id", "left")
        .groupBy(X.month_start("date_became_customer").alias("acquisition_month"))
        .agg(
            F.count(F.lit(1)).alias("new_customers_acquired"),
            F.sum(spend).alias("cohort_lifetime_revenue"),
            X.money_avg(spend).alias("avg_customer_lifetime_value"),
            F.count_if(status.isin(*sets.active)).alias("still_active"),
            F.count_if(status.isin(*sets.inactive)).alias("became_inactive"),
            F.count_if(F.col("amount_outstanding") > 0).alias("currently_owe_balance"),
            F.count_if(F.col("_has_lesson")).alias("customers_with_lessons"),
        )
        .orderBy(F.desc("acquisition_month"))
    )


def customer_value_segments(ds: Dataset, sets: StatusSets = StatusSets()) -> DataFrame:
    """High value (at or above the 75th percentile) and at risk (owes much, below the median).

    The published report repeats a customer's payments once per matching lesson
    but compares with percentiles of the plain totals. ``sets.fan_out`` keeps
    that by multiplying, so the repeated rows are never produced.
    """
    active = ds.customers.where(F.col("customer_status_code").isin(*sets.active)).select(
        "customer_id", "amount_outstanding"
    )
    with_paid = active.join(_paid(ds).select("customer_id", "total_paid"), "customer_id", "left").select(
        "customer_id", "amount_outstanding", X.zero_if_null("total_paid").alias("paid")
    )
    if sets.fan_out:
        taught = (
            ds.lessons.where(F.col("lesson_status_code").isin(*S.DONE_OR_CONFIRMED))
            .groupBy("customer_id")
            .agg(F.count(F.lit(1)).alias("_n"))
        )
        times = F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1)).cast("decimal(10,0)")
        metrics = with_paid.join(taught, "customer_id", "left").withColumn(
            "value", (F.col("paid") * times).cast("decimal(28,2)")
        )
    else:
        metrics = with_paid.withColumn("value", F.col("paid").cast("decimal(28,2)"))
    marks = exact_percentiles(with_paid, "paid", [0.75, 0.5])
    mark = marks.select(F.struct("p0", "p1")).scalar()
    value = F.col("value").cast("double")
    owes = F.col("amount_outstanding")
    flagged = metrics.withColumn("_mark", mark)
    segments = F.array_compact(
        F.array(
            F.when(value >= F.col("_mark.p0"), "High Value"),
            F.when((owes > S.AT_RISK_OWES_OVER) & (value < F.col("_mark.p1")), "At Risk"),
        )
    )
    found = (
        flagged.select("value", "amount_outstanding", F.explode(segments).alias("segment"))
        .groupBy("segment")
        .agg(
            F.count(F.lit(1)).alias("customer_count"),
            X.money_avg("value").alias("avg_lifetime_value"),
            F.sum("value").alias("segment_total_value"),
            X.money_avg("amount_outstanding").alias("avg_outstanding"),
            F.count_if(F.col("amount_outstanding") > 0).alias("customers_owing"),
        )
    )
    # Both segments are always reported, with NULL amounts when they are empty.
    labels = ds.spark.sql("SELECT * FROM VALUES ('High Value'), ('At Risk') AS t(segment)")
    zero = F.lit(0).cast("long")
    return labels.join(found, "segment", "left").select(
        "segment",
        F.coalesce("customer_count", zero).alias("customer_count"),
        "avg_lifetime_value",
        "segment_total_value",
        "avg_outstanding",
        F.coalesce("customers_owing", zero).alias("customers_owing"),
    )


def scheduling_efficiency(ds: Dataset) -> DataFrame:
    """Week x weekday x hour x status."""
    return (
        ds.lessons.groupBy(
            X.week_start("lesson_date").alias("week_starting"),
            X.weekday_from_sunday("lesson_date").alias("day_of_week"),
            X.hour_of().alias("lesson_hour"),
            "lesson_status_code",
        )
        .agg(
            F.count(F.lit(1)).alias("lessons_booked"),
            F.count_distinct("vehicle_id").alias("vehicles_used"),
            F.count_distinct("staff_id").alias("instructors_assigned"),
            X.money_avg("price").alias("avg_lesson_price"),
            F.sum("price").alias("weekly_revenue"),
        )
        .orderBy(F.desc("week_starting"), "day_of_week", "lesson_hour", "lesson_status_code")
    )


def lesson_completion_metrics(ds: Dataset, clock: Clock, sets: StatusSets = StatusSets()) -> DataFrame:
    """The last 90 days and everything after them; there is no upper bound."""
    status, price = F.col("lesson_status_code"), F.col("price")
    done, cancelled = status.isin(*S.DONE_OR_CONFIRMED), status == S.CANCELLED
    since = F.date_sub(F.lit(clock.date), S.METRICS_WINDOW_DAYS)

    def revenue(cond: Column) -> Column:
        # NULL only when there is no lesson at all.
        return F.sum(F.when(cond, price).otherwise(F.lit(0).cast("decimal(10,2)")))

    counts = ds.lessons.where(F.col("lesson_date") >= since).agg(
        F.count(F.lit(1)).alias("total_lessons"),
        F.count_if(done).alias("completed"),
        F.count_if(cancelled).alias("cancelled"),
        F.count_if(status == S.RESCHEDULED).alias("rescheduled"),
        F.count_if(status.isin(*sets.pending)).alias("pending"),
        F.sum("price").alias("total_lesson_revenue"),
        revenue(done).alias("completed_revenue"),
        revenue(cancelled).alias("lost_revenue_cancelled"),
    )
    total = F.col("total_lessons")
    return counts.select(
        "total_lessons", "completed", "cancelled", "rescheduled", "pending",
        X.percent(F.col("completed"), total, 1).alias("completion_rate_percent"),
        X.percent(F.col("cancelled"), total, 1).alias("cancellation_rate_percent"),
        "total_lesson_revenue", "completed_revenue", "lost_revenue_cancelled",
    )
