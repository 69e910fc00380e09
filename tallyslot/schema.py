"""Declared data model: column types, keys, references, checks and code sets.

Everything here is data. The loader checks incoming tables against it and the
quality jobs (``plans/quality.py``) turn it into scans, joins and aggregates.
Clock times are held as seconds of the day because Spark cannot store TIME.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
LONG, INT, TEXT = T.LongType(), T.IntegerType(), T.StringType()
DATE, STAMP, FLAG = T.DateType(), T.TimestampNTZType(), T.BooleanType()


@dataclass(frozen=True)
class Col:
    """One declared column: type, nullability, text length limit and default."""

    name: str
    type: T.DataType
    required: bool = False
    length: int | None = None
    default: object = None


def _text(name, length=None, required=False, default=None):
    return Col(name, TEXT, required, length, default)


# --- fixed values: table layouts, lengths and defaults -----------------------
TABLES: dict[str, list[Col]] = {
    "customer_status": [
        _text("customer_status_code", 10, True),
        _text("customer_status_description", 100, True),
    ],
    "lesson_status": [
        _text("lesson_status_code", 10, True),
        _text("lesson_status_description", 100, True),
    ],
    "payment_methods": [
        _text("payment_method_code", 10, True),
        _text("payment_method_description", 100, True),
    ],
    "addresses": [
        Col("address_id", LONG, True),
        _text("line_1_number_building", 100, True),
        _text("line_2_number_street", 100),
        _text("line_3_area_locality", 100),
        _text("city", 100, True),
        _text("zip_postcode", 20, True),
        _text("state_province_county", 100),
        _text("country", 100, True, "Canada"),
        _text("other_address_details"),
    ],
    "vehicles": [Col("vehicle_id", LONG, True), _text("vehicle_details", 100, True)],
    "staff": [
        Col("staff_id", LONG, True),
        Col("staff_address_id", LONG),
        _text("customer_status_code", 10, True),
        _text("nickname", 50),
        _text("first_name", 50, True),
        _text("middle_name", 50),
        _text("last_name", 50, True),
        Col("date_of_birth", DATE),
        Col("date_joined_staff", STAMP, True),
        Col("date_left_staff", STAMP),
        _text("other_staff_details"),
    ],
    "customers": [
        Col("customer_id", LONG, True),
        Col("customer_address_id", LONG),
        _text("customer_status_code", 10, True),
        Col("date_became_customer", DATE, True),
        Col("date_of_birth", DATE, True),
        _text("first_name", 50, True),
        _text("last_name", 50, True),
        Col("amount_outstanding", MONEY, True, default="0.00"),
        _text("email_address", 150),
        _text("phone_number", 30),
        _text("cell_mobile_phone_number", 30),
        _text("other_customer_details"),
    ],
    "payments": [
        Col("customer_id", LONG, True),
        Col("datetime_payment", STAMP, True),
        _text("payment_method_code", 10, True),
        Col("amount_payment", MONEY, True),
        _text("other_payment_details"),
    ],
    "lessons": [
        Col("lesson_id", LONG, True),
        Col("customer_id", LONG, True),
        _text("lesson_status_code", 10, True),
        Col("staff_id", LONG),
        Col("vehicle_id", LONG),
        Col("lesson_date", DATE, True),
        Col("lesson_time_sec", INT, True),
        Col("price", MONEY, True),
        _text("other_lesson_details"),
    ],
    "app_roles": [
        _text("role_code", 50, True),
        _text("role_name", 100, True),
        _text("description"),
    ],
    "app_users": [
        Col("user_id", LONG, True),
        _text("email", 255, True),
        _text("full_name", 200),
        Col("is_active", FLAG, True, default="true"),
        Col("staff_id", LONG),
        Col("customer_id", LONG),
        Col("failed_attempts", INT, True, default="0"),
        Col("locked_until", STAMP),
        Col("created_at", STAMP, True),
        Col("last_login_at", STAMP),
    ],
    "app_user_roles": [
        Col("user_id", LONG, True),
        _text("role_code", 50, True),
        Col("assigned_at", STAMP, True),
    ],
    "app_login_audit": [
        Col("audit_id", LONG, True),
        _text("email", 255),
        Col("user_id", LONG),
        Col("success", FLAG, True),
        _text("detail", 200),
        Col("attempted_at", STAMP, True),
    ],
    "lesson_audit_log": [
        Col("audit_id", LONG, True),
        Col("lesson_id", LONG, True),
        _text("old_status", 10),
        _text("new_status", 10),
        Col("changed_at", STAMP, True),
        _text("changed_by", 100, default="system"),
    ],
}

# Written in lower case without surrounding blanks.
NORMAL_EMAILS = {("app_users", "email")}

# --- fixed values: code sets -------------------------------------------------
CUSTOMER_STATUS = [
    ("ACT", "Active"),
    ("INA", "Inactive"),
    ("SUS", "Suspended for non-payment"),
    ("PASS", "Passed test - archived"),
    ("LEAD", "Prospective lead, not yet enrolled"),
]
LESSON_STATUS = [
    ("BOOK", "Booked"),
    ("CONF", "Confirmed"),
    ("COMP", "Completed"),
    ("CANC", "Cancelled by customer"),
    ("NOSH", "No show"),
    ("RESC", "Rescheduled"),
]
PAYMENT_METHODS = [
    ("CASH", "Cash"),
    ("CARD", "Debit / Credit card"),
    ("BANK", "Bank transfer / Interac e-Transfer"),
    ("DD", "Pre-authorized debit"),
    ("VOUCH", "Gift voucher"),
]
ROLES = [
    ("ADMIN", "Administrator"),
    ("STAFF", "Front-desk staff"),
    ("REPORT", "Reporting analyst"),
]

# --- fixed values: keys (a nullable unique column ignores its nulls) ---------
KEYS: list[tuple[str, tuple[str, ...]]] = [
    ("customer_status", ("customer_status_code",)),
    ("lesson_status", ("lesson_status_code",)),
    ("payment_methods", ("payment_method_code",)),
    ("addresses", ("address_id",)),
    ("vehicles", ("vehicle_id",)),
    ("staff", ("staff_id",)),
    ("customers", ("customer_id",)),
    ("customers", ("email_address",)),
    ("payments", ("customer_id", "datetime_payment")),
    ("lessons", ("lesson_id",)),
    ("app_roles", ("role_code",)),
    ("app_users", ("user_id",)),
    ("app_users", ("email",)),
    ("app_user_roles", ("user_id", "role_code")),
    ("app_login_audit", ("audit_id",)),
    ("lesson_audit_log", ("audit_id",)),
]


@dataclass(frozen=True)
class Ref:
    """A reference from ``table.column`` to ``parent.parent_key``."""

    table: str
    column: str
    parent: str
    parent_key: str
    on_delete: str


# --- fixed values: references and what happens when the parent row goes ------
REFS: list[Ref] = [
    Ref("staff", "staff_address_id", "addresses", "address_id", "set_null"),
    Ref("staff", "customer_status_code", "customer_status", "customer_status_code", "restrict"),
    Ref("customers", "customer_address_id", "addresses", "address_id", "set_null"),
    Ref("customers", "customer_status_code", "customer_status", "customer_status_code", "restrict"),
    Ref("payments", "customer_id", "customers", "customer_id", "cascade"),
    Ref("payments", "payment_method_code", "payment_methods", "payment_method_code", "restrict"),
    Ref("lessons", "customer_id", "customers", "customer_id", "restrict"),
    Ref("lessons", "lesson_status_code", "lesson_status", "lesson_status_code", "restrict"),
    Ref("lessons", "staff_id", "staff", "staff_id", "set_null"),
    Ref("lessons", "vehicle_id", "vehicles", "vehicle_id", "set_null"),
    Ref("app_users", "staff_id", "staff", "staff_id", "set_null"),
    Ref("app_users", "customer_id", "customers", "customer_id", "set_null"),
    Ref("app_user_roles", "user_id", "app_users", "user_id", "cascade"),
    Ref("app_user_roles", "role_code", "app_roles", "role_code", "restrict"),
    Ref("lesson_audit_log", "lesson_id", "lessons", "lesson_id", "cascade"),
]

# --- fixed values: row checks; a check that is NULL passes -------------------
CHECKS: list[tuple[str, str, str]] = [
    ("staff", "left_after_join", "date_left_staff IS NULL OR date_left_staff >= date_joined_staff"),
    ("customers", "outstanding_not_negative", "amount_outstanding >= 0"),
    ("payments", "payment_positive", "amount_payment > 0"),
    ("lessons", "price_not_negative", "price >= 0"),
    ("app_users", "email_has_at_sign", "locate('@', email) > 1"),
]


def struct(table: str) -> T.StructType:
    """Spark schema of a declared table."""
    return T.StructType([T.StructField(c.name, c.type, True) for c in TABLES[table]])
