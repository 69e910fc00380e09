"""Reports and lists built on the views, with filters, flags and totals inside the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyslot import settings as S
from tallyslot.functions import exprs as X
from tallyslot.operators.keyed import HotKeys, look_up
from tallyslot.plans import views as V
from tallyslot.settings import Clock, Scale
from tallyslot.sources.dataset import Dataset


# --- lists -------------------------------------------------------------------
def scan_project(ds: Dataset) -> DataFrame:
    """Narrow scan of customers: only the columns a picker needs leave the file."""
    return ds.customers.select(
        "customer_id", X.full_name("first_name", "last_name").alias("name"), "customer_status_code"
    )


def lookup_reference(ds: Dataset) -> DataFrame:
    """Every code with its description, display colour and number of rows that use it."""

    def usage(lookup: DataFrame, facts: DataFrame, code: str, text: str, label: str) -> DataFrame:
        used = facts.groupBy(code).agg(F.count(F.lit(1)).alias("_used"))
        colour = {
            "customer_status": X.customer_colour(code),
            "lesson_status": X.lesson_colour(text),
        }.get(label, F.lit(None).cast("string"))
        return lookup.join(used, code, "left").select(
            F.lit(label).alias("lookup"),
            F.col(code).alias("code"),
            F.col(text).alias("description"),
            colour.alias("colour"),
            F.coalesce("_used", F.lit(0).cast("long")).alias("rows_using"),
        )

    return (
        usage(ds.customer_status, ds.customers, "customer_status_code", "customer_status_description", "customer_status")
        .unionByName(usage(ds.lesson_status, ds.lessons, "lesson_status_code", "lesson_status_description", "lesson_status"))
        .unionByName(
            usage(ds.payment_methods, ds.payments, "payment_method_code", "payment_method_description", "payment_methods")
        )
    )


def list_addresses(ds: Dataset) -> DataFrame:
    """Addresses by id, with how many customers live there."""
    used = ds.customers.groupBy(F.col("customer_address_id").alias("address_id")).agg(
        F.count(F.lit(1)).alias("customers_there")
    )
    counted = ds.addresses.join(used, "address_id", "left")
    there = F.coalesce("customers_there", F.lit(0).cast("long")).alias("customers_there")
    return counted.select(*ds.addresses.columns, there).orderBy("address_id")


def list_staff(ds: Dataset) -> DataFrame:
    return ds.staff.select(
        "staff_id",
        X.staff_label("nickname", "first_name", "last_name").alias("instructor"),
        "customer_status_code",
        X.customer_colour("customer_status_code").alias("colour"),
        F.coalesce(F.col("date_joined_staff").cast("date").cast("string"), F.lit(X.DASH)).alias("joined"),
        F.coalesce(F.col("date_left_staff").cast("date").cast("string"), F.lit(X.DASH)).alias("left_on"),
        F.coalesce("other_staff_details", F.lit("")).alias("notes"),
    ).orderBy("staff_id")


def lookup_address(ds: Dataset) -> DataFrame:
    """Each customer's address row, or NULLs; an address id is a key, so at most one row matches."""
    wanted = ds.customers.select("customer_id", F.col("customer_address_id").alias("address_id"))
    return wanted.join(ds.addresses, "address_id", "left").select(
        "customer_id", "address_id", "line_1_number_building", "line_2_number_street", "line_3_area_locality",
        "city", "zip_postcode", "state_province_county", "country",
    )


def one_address(ds: Dataset, address_id: int) -> DataFrame:
    """Zero or one row; a second row would break the key and is left visible to the caller."""
    return ds.addresses.where(F.col("address_id") == address_id).limit(2)


def edit_lessons(ds: Dataset) -> DataFrame:
    """Lessons as an edit form shows them: renamed, time as HH:MM, missing note as ''."""
    return ds.lessons.select(
        "lesson_id",
        F.col("customer_id").alias("cust"),
        F.col("staff_id").alias("staff"),
        F.col("vehicle_id").alias("veh"),
        F.col("lesson_date").alias("date"),
        X.clock_text().alias("time"),
        "price",
        F.coalesce("other_lesson_details", F.lit("")).alias("notes"),
        F.col("lesson_status_code").alias("status_code"),
    )


def one_lesson(ds: Dataset, lesson_id: int) -> DataFrame:
    return edit_lessons(ds).where(F.col("lesson_id") == lesson_id).limit(2)


def payment_history(ds: Dataset, customer_id: int | None = None, scale: Scale = Scale()) -> DataFrame:
    """Payments newest first, each with its customer's payment count and total.

    A customer with very many payments is split over tasks.
    """
    rows = V.view_customer_payments(ds).where(F.col("customer_id").isNotNull())
    paid = ds.payments
    if customer_id is not None:
        rows = rows.where(F.col("customer_id") == customer_id)
        paid = paid.where(F.col("customer_id") == customer_id)
    totals = paid.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("payments_of_customer"), F.sum("amount_payment").alias("total_of_customer")
    )
    name = F.trim(
        F.concat(F.coalesce("first_name", F.lit("")), F.lit(" "), F.coalesce("last_name", F.lit("")))
    )
    hot = HotKeys(paid, [["customer_id"]], scale.hot_rows)
    return (
        look_up(rows, ["customer_id"], totals, ["customer_id"], hot)
        .select(
            "customer_id",
            name.alias("customer_name"),
            "datetime_payment",
            "payment_method_code",
            F.coalesce("payment_method_description", "payment_method_code", F.lit(X.DASH)).alias("method_shown"),
            "amount_payment",
            F.coalesce("other_payment_details", F.lit("")).alias("note"),
            "payments_of_customer",
            "total_of_customer",
        )
        .orderBy("customer_id", F.desc("datetime_payment"))
    )


def customer_directory(ds: Dataset, clock: Clock) -> DataFrame:
    """The customer list: address view, stored balance and base columns.

    All three come from the customer row, so no charge or payment is touched.
    """
    base = [
        F.coalesce("amount_outstanding", F.lit(0).cast("decimal(10,2)")).alias("balance"),
        F.col("customer_status_code").alias("status_code"),
        X.customer_colour("customer_status_code").alias("status_colour"),
        F.col("first_name").alias("first"),
        F.col("last_name").alias("last"),
        F.col("date_of_birth").alias("dob"),
        F.col("date_became_customer").alias("since"),
        F.col("address_id").alias("addr"),
    ]
    return V.customer_full_address(ds, clock, *base).withColumn(
        "balance_band", X.balance_band(F.col("balance"), S.MINOR_BALANCE_BELOW)
    )


def list_lessons(ds: Dataset) -> DataFrame:
    """Newest first; a missing vehicle shows as a dash, a missing instructor stays one space."""
    return V.lesson_details(ds).select(
        "lesson_id",
        F.col("lesson_date").alias("date"),
        X.clock_text().alias("time"),
        F.col("customer_name").alias("customer"),
        X.or_dash("instructor_name").alias("instructor"),
        X.or_dash("vehicle_details").alias("vehicle"),
        X.before_plate(X.or_dash("vehicle_details")).alias("vehicle_label"),
        "price",
        "status",
        X.lesson_colour("status").alias("status_colour"),
        F.col("other_lesson_details").alias("notes"),
    ).orderBy(F.desc("date"), "lesson_id")


def cancellable_lessons(ds: Dataset) -> DataFrame:
    return V.lesson_details(ds).where(F.col("status").isin(*S.CANCELLABLE)).select(
        "lesson_id", "lesson_date", "status", "customer_name"
    )


def bookable_instructors(ds: Dataset) -> DataFrame:
    """Not left and no 'administrator' in the note, in any case; a NULL note is kept."""
    notes = F.coalesce("other_staff_details", F.lit(""))
    return ds.staff.where(F.col("date_left_staff").isNull() & ~notes.rlike("(?i)administrator")).select(
        "staff_id", X.full_name("first_name", "last_name").alias("instructor_name")
    )


ADDRESS_TEXT = [
    "line_1_number_building", "line_2_number_street", "line_3_area_locality", "city", "zip_postcode",
    "state_province_county",
]


def search_addresses(ds: Dataset, needle: str, limit: int = S.SEARCH_LIMIT) -> DataFrame:
    """The first matches of one search text, by address id."""
    return (
        ds.addresses.where(X.contains_any(ADDRESS_TEXT, F.lit(needle)))
        .select("address_id", X.joined_parts(ADDRESS_TEXT[:5], keep_empty=False).alias("label"))
        .orderBy("address_id")
        .limit(limit)
    )


def address_search(ds: Dataset, searches: DataFrame, limit: int = S.SEARCH_LIMIT) -> DataFrame:
    """The first matches for many search texts: ``search_id, address_id, label, rank``.

    Equal texts are searched once. Containment has no key to join on, so texts
    meet address parts through the short character runs (grams) of the parts.
    """
    texts = searches.select("search_id", F.lower(F.trim("needle")).alias("_q")).where(F.length("_q") > 0)
    distinct = texts.select("_q").distinct()

    part = F.explode(F.array(*[F.lower(F.coalesce(c, F.lit(""))) for c in ADDRESS_TEXT]))
    parts = ds.addresses.select("address_id", part.alias("_part")).where(F.length("_part") > 0).distinct()
    index = parts.select("address_id", "_part", F.explode(_grams("_part")).alias("_gram"))

    # Up to three characters: the text is itself a gram, so each gram's first ids are the answer.
    short = distinct.where(F.length("_q") <= 3)
    by_gram = _lowest(index.select("_gram", "address_id").distinct(), "_gram", "address_id", limit)
    short_hits = short.join(by_gram, short["_q"] == by_gram["_gram"]).select("_q", "address_id", "rank")

    # Longer: look up the text's rarest gram, then check the whole text.
    sizes = index.groupBy("_gram").agg(F.count(F.lit(1)).alias("_size"))
    long = distinct.where(F.length("_q") > 3).select("_q", F.explode(_grams("_q", (3,))).alias("_gram"))
    rarest = long.join(sizes, "_gram", "left").groupBy("_q").agg(
        F.min_by("_gram", F.coalesce("_size", F.lit(0))).alias("_gram")
    )
    checked = rarest.join(index, "_gram").where(F.col("_part").contains(F.col("_q")))
    long_hits = _lowest(checked.select("_q", "address_id").distinct(), "_q", "address_id", limit)

    best = short_hits.unionByName(long_hits)
    labels = ds.addresses.select("address_id", X.joined_parts(ADDRESS_TEXT[:5], keep_empty=False).alias("label"))
    return texts.join(best, "_q").join(labels, "address_id").select("search_id", "address_id", "label", "rank")


def _grams(text: str, sizes: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Distinct substrings of the given lengths."""
    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.substring(F.col(text), i, F.lit(n)))

    return F.array_distinct(F.concat(*[of_size(n) for n in sizes]))


def _lowest(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """The ``n`` lowest values per key with their rank.

    Spark applies the rank limit before the shuffle too, so a task sends on at
    most ``n`` rows per key.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(value))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def roles_panel(ds: Dataset) -> DataFrame:
    """Users by e-mail with the roles they hold; falls back to the users' role text."""
    known = V.role_lists(V.user_roles(ds)).withColumnRenamed("roles", "_known")
    users = V.app_users(ds)
    from_text = F.filter(F.split("roles", ","), lambda r: r != "")
    return (
        users.join(known, "user_id", "left")
        .select(
            "user_id",
            F.coalesce(X.blank_to_null("full_name"), "email").alias("shown_as"),
            "email",
            F.coalesce("_known", from_text).alias("roles"),
        )
        .orderBy("email")
    )


def contact_quality(ds: Dataset) -> DataFrame:
    """Whether each customer's e-mail and mobile number would pass the entry form."""
    return ds.customers.select(
        "customer_id",
        "email_address",
        (X.is_blank("email_address") | X.valid_email("email_address")).alias("email_ok"),
        "cell_mobile_phone_number",
        X.valid_phone("cell_mobile_phone_number").alias("phone_ok"),
    )


# --- the four reports and the headline ---------------------------------------
def workload_with_lessons(ds: Dataset) -> DataFrame:
    return V.instructor_workload(ds).where(F.col("total_lessons") > 0)


def report_instructor_reliability(ds: Dataset) -> DataFrame:
    pct = X.percent(F.col("completed_lessons"), F.col("total_lessons"), 1)
    return (
        workload_with_lessons(ds)
        .withColumn("completion_percent", F.coalesce(pct, F.lit(0).cast("decimal(3,1)")))
        .withColumn("band", X.completion_band(F.col("completion_percent"), S.COMPLETION_GREEN, S.COMPLETION_AMBER))
        .orderBy(F.desc("revenue_generated"), "staff_id")
    )


def monthly_report(ds: Dataset) -> DataFrame:
    return V.monthly_revenue(ds).orderBy("pay_month", "method")


def _debtors(ds: Dataset) -> DataFrame:
    return V.customer_balance(ds).where(F.col("total_charged") > 0).withColumn(
        "action", X.balance_band(F.col("calculated_outstanding"), S.MINOR_BALANCE_BELOW)
    )


def report_debtors(ds: Dataset) -> DataFrame:
    """Customers with charges, largest exposure first."""
    return _debtors(ds).orderBy(F.desc("calculated_outstanding"), "customer_id")


def report_fleet(ds: Dataset) -> DataFrame:
    return (
        V.vehicle_utilisation(ds)
        .withColumn("vehicle_label", X.before_plate("vehicle_details"))
        .orderBy(F.desc("lessons_completed"), "vehicle_id")
    )


def report_headline(ds: Dataset) -> DataFrame:
    """One row: top earner, money collected, money outstanding."""
    top = (
        workload_with_lessons(ds)
        .orderBy(F.desc("revenue_generated"), "staff_id")
        .limit(1)
        .select(F.struct("instructor_name", "revenue_generated", "completed_lessons"))
        .scalar()
    )
    owed = _debtors(ds).agg(
        F.sum(F.greatest(F.col("calculated_outstanding"), F.lit(0))).alias("owed"),
        F.count_if(F.col("action") == "Chase for payment").alias("chase"),
    )
    money = V.monthly_revenue(ds).agg(
        F.sum("total_collected").alias("collected"), F.sum("num_payments").alias("payments")
    )
    row = owed.withColumn("_top", top).withColumn("_money", money.select(F.struct("collected", "payments")).scalar())
    zero = F.lit(0).cast("long")
    return row.select(
        F.coalesce(F.substring_index("_top.instructor_name", " ", 1), F.lit(X.DASH)).alias("top_earner"),
        X.money_text("_top.revenue_generated").alias("top_revenue"),
        F.coalesce("_top.completed_lessons", zero).alias("top_completed"),
        X.money_text("_money.collected").alias("collected"),
        F.coalesce("_money.payments", zero).alias("payments"),
        X.money_text("owed").alias("outstanding"),
        F.coalesce("chase", zero).alias("customers_to_chase"),
    )


def balance_drift(ds: Dataset) -> DataFrame:
    """Customers whose stored balance differs from charges minus payments."""
    drift = F.col("calculated_outstanding") - F.col("stored_outstanding")
    return V.customer_balance(ds).where(drift != 0).withColumn("drift", drift)
