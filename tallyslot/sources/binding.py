"""Bind a star-schema folder (orders, events, customer, ...) to the booking model.

Orders become lessons, events become payments and sign-in attempts, suppliers
become staff and users, parts become vehicles. Every derived table covers its
whole source table; remainders of keys only decide which edge case a row shows.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyslot import schema
from tallyslot.sources.dataset import Dataset, conform

# --- fixed values: event types as payment methods, source kinds as codes -----
EVENT_METHOD = (
    "CASE event_type WHEN 'click' THEN 'CASH' WHEN 'error' THEN 'CARD' WHEN 'purchase' THEN 'BANK' "
    "WHEN 'signup' THEN 'DD' ELSE '{other}' END"
)
# Payments are spread over twelve 30-day steps.
PAYMENT_TIME = "timestampadd(DAY, CAST(event_id % 12 * 30 AS INT), ts)"


def day(start: str, offset: str) -> str:
    return f"date_add(DATE '{start}', CAST({offset} AS INT))"


# table: (source table, columns). {suppliers} and {parts} become row counts of those tables.
DERIVED: dict[str, tuple[str, list[str]]] = {
    "addresses": (
        "places",
        [
            "n_nationkey AS address_id",
            "CAST(n_nationkey AS STRING) AS line_1_number_building",
            "CASE WHEN n_nationkey % 4 <> 0 THEN n_name END AS line_2_number_street",
            "CASE WHEN n_nationkey % 3 <> 0 THEN concat('Area ', n_regionkey) END AS line_3_area_locality",
            "r_name AS city",
            "concat('Z', n_nationkey) AS zip_postcode",
            "CASE WHEN n_nationkey % 5 <> 0 THEN r_name END AS state_province_county",
        ],
    ),
    "vehicles": (
        "part",
        ["p_partkey AS vehicle_id", "concat_ws(' - ', p_name, p_type, concat('Plate ', p_partkey)) AS vehicle_details"],
    ),
    "staff": (
        "supplier",
        [
            "s_suppkey AS staff_id",
            "s_nationkey AS staff_address_id",
            "IF(s_suppkey % 5 = 0, 'INA', 'ACT') AS customer_status_code",
            "CASE WHEN s_suppkey % 3 <> 0 THEN concat('Nick', s_suppkey) END AS nickname",
            "'Staff' AS first_name",
            "s_name AS last_name",
            f"CASE WHEN s_suppkey % 9 <> 4 THEN {day('1960-01-01', 's_suppkey * 101 % 12000')} END AS date_of_birth",
            f"{day('1994-01-01', 's_suppkey * 11 % 1000')} AS date_joined_staff",
            f"CASE WHEN s_suppkey % 5 = 0 THEN {day('2000-01-01', 's_suppkey % 300')} END AS date_left_staff",
            "CASE s_suppkey % 7 WHEN 2 THEN 'Office administrator - not an instructor' WHEN 3 THEN NULL "
            "WHEN 4 THEN 'Administrator' ELSE 'Licensed instructor' END AS other_staff_details",
        ],
    ),
    "customers": (
        "customer",
        [
            "c_custkey AS customer_id",
            "CASE WHEN c_custkey % 13 <> 0 THEN c_nationkey END AS customer_address_id",
            "CASE c_custkey % 10 WHEN 6 THEN 'LEAD' WHEN 7 THEN 'INA' WHEN 8 THEN 'SUS' WHEN 9 THEN 'PASS' ELSE 'ACT' END "
            "AS customer_status_code",
            f"{day('2022-01-01', 'c_custkey * 7 % 730')} AS date_became_customer",
            f"{day('1980-01-01', 'c_custkey * 37 % 7000')} AS date_of_birth",
            "c_mktsegment AS first_name",
            "c_name AS last_name",
            "CAST(greatest(c_acctbal, 0) AS DECIMAL(10,2)) AS amount_outstanding",
            "CASE WHEN c_custkey % 11 <> 0 THEN concat(lower(c_mktsegment), '.', c_custkey, '@example.ca') END AS email_address",
            "CASE WHEN c_custkey % 6 = 1 THEN 'ext. none' WHEN c_custkey % 6 > 1 "
            "THEN concat('(587) 555-', 1000 + c_custkey % 9000) END AS cell_mobile_phone_number",
        ],
    ),
    "lessons": (
        "orders",
        [
            "o_orderkey AS lesson_id",
            "o_custkey AS customer_id",
            "CASE o_orderkey % 10 WHEN 0 THEN 'BOOK' WHEN 1 THEN 'CONF' WHEN 2 THEN 'CANC' WHEN 3 THEN 'NOSH' "
            "WHEN 4 THEN 'RESC' ELSE 'COMP' END AS lesson_status_code",
            "CASE WHEN o_orderkey % 17 <> 0 THEN (o_orderkey * 7 + o_custkey) % {suppliers} END AS staff_id",
            "CASE WHEN o_orderkey % 19 <> 0 THEN (o_orderkey + o_custkey * 3) % {parts} END AS vehicle_id",
            "CAST(o_orderdate AS DATE) AS lesson_date",
            "CAST((9 + o_custkey % 3) * 3600 AS INT) AS lesson_time_sec",
            "CAST(o_totalprice AS DECIMAL(10,2)) AS price",
            "o_orderpriority AS other_lesson_details",
        ],
    ),
    "payments": (
        "events",
        [
            "user_id AS customer_id",
            f"{PAYMENT_TIME} AS datetime_payment",
            f"{EVENT_METHOD.format(other='VOUCH')} AS payment_method_code",
            "CAST(value AS DECIMAL(10,2)) AS amount_payment",
            "props AS other_payment_details",
        ],
    ),
    "app_users": (
        "supplier",
        [
            "s_suppkey AS user_id",
            "concat('user', s_suppkey, '@example.ca') AS email",
            "s_name AS full_name",
            "s_suppkey % 8 <> 3 AS is_active",
            "CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS staff_id",
            "CASE WHEN s_suppkey % 2 = 1 THEN s_suppkey END AS customer_id",
            f"{day('2023-01-01', 's_suppkey % 365')} AS created_at",
        ],
    ),
    "app_user_roles": (
        "supplier",
        [
            "s_suppkey AS user_id",
            "explode(array_compact(array(IF(s_suppkey % 4 = 0, 'ADMIN', NULL), "
            "IF((s_suppkey + 1) % 4 = 0 OR s_suppkey % 6 = 0, 'STAFF', NULL), "
            "IF((s_suppkey + 2) % 4 = 0, 'REPORT', NULL)))) AS role_code",
            f"{day('2023-06-01', 's_suppkey % 100')} AS assigned_at",
        ],
    ),
    "login_attempts": (
        "events",
        [
            "event_id AS attempt_id",
            "concat('user', user_id, '@example.ca') AS email",
            "ts AS attempted_at",
            "event_type IN ('purchase', 'view') AS password_ok",
        ],
    ),
    "lesson_versions": (
        "order_versions",
        [
            "o_orderkey AS lesson_id",
            "version",
            "CASE (o_orderkey + version * (o_orderkey % 3)) % 6 WHEN 0 THEN 'BOOK' WHEN 1 THEN 'CONF' WHEN 2 THEN 'COMP' "
            "WHEN 3 THEN 'CANC' WHEN 4 THEN 'NOSH' ELSE 'RESC' END AS lesson_status_code",
        ],
    ),
    "app_login_audit": (
        "events",
        [
            "event_id AS audit_id",
            "concat('user', user_id, '@example.ca') AS email",
            "user_id",
            "event_type IN ('purchase', 'view') AS success",
            "IF(event_type IN ('purchase', 'view'), 'ok', 'bad password') AS detail",
            "ts AS attempted_at",
        ],
    ),
    "lesson_audit_log": (
        "orders",
        [
            "o_orderkey AS audit_id",
            "o_orderkey + IF(o_orderkey % 1000 = 999, 100000000, 0) AS lesson_id",
            "'BOOK' AS old_status",
            "IF(o_orderstatus = 'F', 'COMP', 'CONF') AS new_status",
            "o_orderdate AS changed_at",
        ],
    ),
    "booking_requests": (
        "orders",
        [
            "o_orderkey AS request_id",
            "o_custkey + IF(o_orderkey % 23 = 0, 10000000, 0) AS customer_id",
            "CASE WHEN o_orderkey % 35 = 0 THEN NULL WHEN o_orderkey % 55 = 0 THEN -1 "
            "ELSE (o_orderkey * 3 + o_custkey) % {suppliers} END AS staff_id",
            "CASE WHEN o_orderkey % 65 <> 0 THEN (o_orderkey + o_custkey) % 60 END AS vehicle_id",
            f"{day('2001-05-30', 'o_orderkey div 5 % 30')} AS lesson_date",
            "CAST((9 + o_custkey % 7) * 3600 AS INT) AS lesson_time_sec",
            "CAST(IF(o_orderkey % 29 = 0, -1, o_totalprice) AS DECIMAL(10,2)) AS price",
        ],
    ),
    "payment_requests": (
        "events",
        [
            "event_id AS request_id",
            "user_id + IF(event_id % 11 = 0, 10000000, 0) AS customer_id",
            "ts AS datetime_payment",
            f"{EVENT_METHOD.format(other='XXX')} AS payment_method_code",
            "CAST(CASE WHEN event_id % 13 = 0 THEN 0 WHEN event_id % 17 = 0 THEN NULL ELSE value END AS DECIMAL(10,2)) AS amount",
            "CASE WHEN event_id % 4 <> 0 THEN props END AS details",
        ],
    ),
    # One to three corrections per payment, in waves: each next one starts where the one before has moved the payment to,
    # some move to instants that others leave, some back.
    "payment_corrections": (
        "event_repeats",
        [
            "event_id + i * 10000000000 AS request_id",
            "user_id AS customer_id",
            f"timestampadd(MINUTE, CAST(IF(event_id % 4 = 1, 5 * i, 0) AS INT), timestampadd(SECOND, IF(event_id % 10 = 7, 1, 0), {PAYMENT_TIME})) "
            "AS original_datetime",
            f"timestampadd(MINUTE, CAST(CASE event_id % 4 WHEN 1 THEN 5 * (i + 1) WHEN 2 THEN -5 * i ELSE 0 END AS INT), {PAYMENT_TIME}) AS new_datetime",
            f"{EVENT_METHOD.format(other='CASH')} AS payment_method_code",
            "CAST(CASE WHEN (event_id + i) % 13 = 0 THEN 0 WHEN (event_id + i) % 19 = 0 THEN NULL ELSE value + (event_id % 5 - 2 + i) * 10 END "
            "AS DECIMAL(10,2)) AS amount",
            "CASE WHEN event_id % 3 <> 0 THEN concat('corrected ', event_id, ' ', i) END AS details",
        ],
    ),
    "cancel_requests": (
        "order_repeats",
        ["o_orderkey * 2 + i AS request_id", "o_orderkey + IF(o_orderkey % 31 = 0, 100000000, 0) AS lesson_id"],
    ),
    # One to four updates of some lessons and one of the others, in waves over all lessons: moves by some days and to fewer staff, so that
    # lessons hand slots on, cancellations, re-opened lessons, unknown lessons and bad prices.
    "lesson_changes": (
        "lesson_repeats",
        [
            "lesson_id + i * 10000000000 AS request_id",
            "lesson_id + IF((lesson_id + i) % 37 = 0, 100000000, 0) AS lesson_id",
            "customer_id",
            "staff_id - IF(i = 1, staff_id % 3, 0) AS staff_id",
            "IF(i = 2, vehicle_id - vehicle_id % 2, vehicle_id) AS vehicle_id",
            "date_add(lesson_date, CAST((lesson_id + i) % 3 * IF(lesson_id % 2 = 0, 1, -1) AS INT)) AS lesson_date",
            "lesson_time_sec",
            "CAST(IF((lesson_id + i) % 41 = 0, -1, price + lesson_id % 3 + i) AS DECIMAL(10,2)) AS price",
            "concat('change ', i) AS other_lesson_details",
            "CASE (lesson_id + i) % 6 WHEN 1 THEN 'CANC' WHEN 2 THEN 'COMP' WHEN 4 THEN 'BOOK' END AS lesson_status_code",
        ],
    ),
    "address_requests": (
        "customer_places",
        [
            "c_custkey AS request_id",
            "CAST(n_nationkey AS STRING) AS line_1_number_building",
            "CASE WHEN n_nationkey % 4 <> 0 THEN n_name END AS line_2_number_street",
            "CASE WHEN n_nationkey % 3 <> 0 THEN concat('Area ', n_regionkey) END AS line_3_area_locality",
            "r_name AS city",
            "IF(c_custkey % 5 = 0, concat('N', c_custkey % 40), concat('Z', n_nationkey)) AS zip_postcode",
            "CASE WHEN n_nationkey % 5 <> 0 THEN r_name END AS state_province_county",
            "CASE WHEN c_custkey % 3 <> 0 THEN 'Canada' END AS country",
        ],
    ),
    # Short, long, padded and blank search texts.
    "address_needles": (
        "customer",
        [
            "c_custkey AS search_id",
            "CASE WHEN c_custkey % 7 = 0 THEN '  ' WHEN c_custkey % 2 = 0 THEN concat(' z', c_nationkey) "
            "WHEN c_custkey % 3 = 0 THEN concat('ation_', c_nationkey % 10) ELSE substr(c_mktsegment, 1, 2) END AS needle",
        ],
    ),
    # One to three adds, updates and deletes per customer, in waves, with faults in the form fields; later waves ask for
    # addresses that earlier ones gave up.
    "customer_changes": (
        "customer_repeats",
        [
            "c_custkey + i * 10000000000 AS request_id",
            "CASE (c_custkey + i * (c_custkey % 5)) % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'update' ELSE 'delete' END AS op",
            "CASE WHEN (c_custkey + i * (c_custkey % 5)) % 3 <> 0 THEN c_custkey END AS customer_id",
            "IF(c_custkey % 21 = 0, '  ', concat('New', c_custkey)) AS first_name",
            "c_name AS last_name",
            f"CASE WHEN c_custkey % 25 <> 0 THEN {day('1985-01-01', 'c_custkey % 5000')} END AS date_of_birth",
            f"{day('2024-01-01', 'c_custkey % 300')} AS date_became_customer",
            "IF(c_custkey % 26 = 0, 'NOPE', 'ACT') AS customer_status_code",
            "CASE WHEN (c_custkey + i) % 12 = 0 THEN 'not-an-address' WHEN (c_custkey + i) % 10 = 1 THEN NULL "
            "WHEN (c_custkey + i) % 9 = 2 THEN concat('shared', c_custkey div 50, '@example.ca') "
            "WHEN (c_custkey + i) % 8 = 3 THEN concat(lower(c_mktsegment), '.', c_custkey + IF(i = 2, 3, 0), '@example.ca') "
            "ELSE concat('new', c_custkey, '@example.ca') END AS email_address",
            "CASE c_custkey % 14 WHEN 3 THEN 'call me' WHEN 4 THEN '12345' WHEN 5 THEN NULL ELSE '+1 587 555 0100' END "
            "AS cell_mobile_phone_number",
            "CASE WHEN c_custkey % 16 <> 0 THEN concat('B', c_custkey % 90) END AS line_1_number_building",
            "CAST(NULL AS STRING) AS line_2_number_street",
            "CAST(NULL AS STRING) AS line_3_area_locality",
            "CASE WHEN c_custkey % 4 <> 0 THEN 'Calgary' END AS city",
            "CASE WHEN c_custkey % 4 <> 0 THEN concat('T', c_custkey % 90) END AS zip_postcode",
            "CAST(NULL AS STRING) AS state_province_county",
            "CAST(NULL AS STRING) AS country",
        ],
    ),
    "staff_changes": (
        "supplier_repeats",
        [
            "s_suppkey * 4 + i AS request_id",
            "CASE WHEN s_suppkey % 4 = 0 THEN 'add' WHEN s_suppkey % 4 = 3 AND i = s_suppkey % 3 THEN 'delete' ELSE 'update' END AS op",
            "CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey END AS staff_id",
            "CAST(NULL AS BIGINT) AS staff_address_id",
            "IF((s_suppkey + i) % 18 = 0, 'NOPE', 'ACT') AS customer_status_code",
            "CAST(NULL AS STRING) AS nickname",
            "IF((s_suppkey + i) % 5 = 0, '', concat('First', s_suppkey, '-', i)) AS first_name",
            "CAST(NULL AS STRING) AS middle_name",
            "s_name AS last_name",
            "CAST(NULL AS DATE) AS date_of_birth",
            f"CAST(CASE WHEN s_suppkey % 22 <> 0 THEN {day('2010-01-01', 's_suppkey % 900')} END AS TIMESTAMP_NTZ) AS date_joined_staff",
            "CASE WHEN s_suppkey % 6 = 1 THEN TIMESTAMP_NTZ '2011-01-01 00:00:00' END AS date_left_staff",
            "'changed' AS other_staff_details",
        ],
    ),
    "role_requests": (
        "events",
        [
            "event_id AS request_id",
            "user_id",
            "CASE event_id % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'Staff' WHEN 2 THEN 'REPORT' WHEN 3 THEN 'report' ELSE 'owner' END AS role_code",
            "IF(event_type = 'error', 'revoke', 'assign') AS action",
            "ts AS requested_at",
        ],
    ),
    "registration_requests": (
        "customer",
        [
            "c_custkey AS request_id",
            "CASE WHEN c_custkey % 17 = 0 THEN '@nobody.ca' WHEN c_custkey % 19 = 0 THEN NULL "
            "WHEN c_custkey % 5 = 0 THEN concat(' USER', c_custkey, '@Example.ca ') "
            "WHEN c_custkey % 7 = 0 THEN concat('group', c_custkey div 40, '@example.ca') "
            "ELSE concat('Person', c_custkey, '@example.ca') END AS email",
            "CASE WHEN c_custkey % 23 <> 0 THEN c_name END AS full_name",
            "CAST(CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 30 + 4 END AS INT) AS password_length",
            "CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'admin' WHEN 2 THEN 'Report' WHEN 3 THEN 'guest' ELSE 'STAFF' END AS role_code",
        ],
    ),
    # Every event asks for the removal of its user, so most users are asked for many times.
    "user_delete_requests": ("events", ["event_id AS request_id", "user_id"]),
}

LOOKUPS = {
    "customer_status": (schema.CUSTOMER_STATUS, "customer_status_code, customer_status_description"),
    "lesson_status": (schema.LESSON_STATUS, "lesson_status_code, lesson_status_description"),
    # VOUCH is left out on purpose: payments then carry a method with no lookup row.
    "payment_methods": (
        [m for m in schema.PAYMENT_METHODS if m[0] != "VOUCH"], "payment_method_code, payment_method_description"
    ),
    "app_roles": (schema.ROLES, "role_code, role_name"),
}


@lru_cache(maxsize=512)
def _schema_of(application: str, path: str) -> StructType:
    """A file's schema, read from its footer once per application."""
    return SparkSession.active().read.parquet(path).schema


def bind_star_schema(
    spark: SparkSession, root: str, streamed: tuple[str, ...] = (), files_per_trigger: int | None = None,
    bytes_per_trigger: int = 1 << 30,
) -> Dataset:
    """A dataset whose base and request tables are derived from ``root``.

    Source tables named in ``streamed`` are read as streams: every file of the
    table is one arrival, and a trigger admits a bounded number of bytes, or of
    files where that is given. A table is one
    file or a folder of part files; nothing beside it is read.
    """

    def layout(name: str) -> StructType:
        return _schema_of(spark.sparkContext.applicationId, f"{root}/{name}.parquet")

    def stored(name: str) -> DataFrame:
        return spark.read.schema(layout(name)).parquet(f"{root}/{name}.parquet")

    def src(name: str) -> DataFrame:
        if name not in streamed:
            return stored(name)
        admitted = ("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else ("maxBytesPerTrigger", bytes_per_trigger)
        return (
            spark.readStream.schema(layout(name))
            .option(*admitted)
            # The pattern matches this one name; without a pattern a stream refuses a table that is a single file.
            .parquet(f"{root}/{name}.parque[t]")
        )

    def places() -> DataFrame:
        return src("nation").join(src("region"), F.expr("n_regionkey = r_regionkey"))

    sources: dict[str, object] = {
        "places": places,
        "customer_places": lambda: src("customer").join(places(), F.expr("c_nationkey = n_nationkey")),
        "order_versions": lambda: src("orders").selectExpr("o_orderkey", "explode(array(1L, 2L, 3L)) AS version"),
        # One to four requests per staff member.
        "supplier_repeats": lambda: src("supplier").selectExpr("*", "explode(sequence(0, CAST(s_suppkey div 2 % 4 AS INT))) AS i"),
        "order_repeats": lambda: src("orders").selectExpr(
            "o_orderkey", "explode(IF(o_orderkey % 4 = 0, array(0, 1), array(0))) AS i"
        ),
        "lesson_repeats": lambda: derive("lessons").selectExpr("*", "explode(sequence(0L, IF(lesson_id % 4 = 0, lesson_id div 4 % 4, 0L))) AS i"),
        # One or two corrections per payment request, and up to three changes per customer.
        "event_repeats": lambda: src("events").selectExpr("*", "explode(sequence(0L, event_id % 3 div 2 + event_id % 5 div 4)) AS i"),
        "customer_repeats": lambda: src("customer").selectExpr("*", "explode(sequence(0L, IF(c_custkey % 2 = 0, c_custkey div 2 % 3, 0L))) AS i"),
    }

    def derive(table: str) -> DataFrame:
        source, columns = DERIVED[table]
        df = sources[source]() if source in sources else src(source)
        sizes = {"{suppliers}": "supplier", "{parts}": "part"}
        for mark, counted in sizes.items():
            if any(mark in c for c in columns):
                name = f"_size_{counted}"
                df = df.withColumn(name, stored(counted).agg(F.count(F.lit(1))).scalar())
                columns = [c.replace(mark, name) for c in columns]
        return df.selectExpr(*columns)

    def lookup(table: str) -> DataFrame:
        """A literal table; Spark knows its size, so joins to it are broadcast by Spark's own rule."""
        pairs, columns = LOOKUPS[table]
        rows = ", ".join("(" + ", ".join(f"'{value}'" for value in pair) + ")" for pair in pairs)
        return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")

    def bound(table: str) -> DataFrame:
        return lookup(table) if table in LOOKUPS else derive(table)

    def build(table: str) -> DataFrame:
        return conform(bound(table), table) if table in schema.TABLES else bound(table)

    names = [*LOOKUPS, *DERIVED]
    return Dataset(spark, {t: (lambda t=t: build(t)) for t in names}, {t: (lambda t=t: bound(t)) for t in names if t in schema.TABLES})
